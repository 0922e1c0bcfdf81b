"""Rows at positions against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

import tableops as to
from tableops.plans.inspect import plan_text
from tableops.plans.selection import rows_at

DDL = "a int, b double, c string"


def _key(row):
    return [(v is None, v != v if isinstance(v, float) else False, v if v == v and v is not None else 0) for v in row]


def _rows(seed, n, hot):
    r = random.Random(seed)
    return [(7, 1.0, "hot") if r.random() < hot else
            (r.choice([None, *range(9)]), r.choice([None, float("nan"), -1.5, 0.25, float("inf")]), r.choice([None, "", "é", "x" * 9]))
            if r.random() < 0.5 else (r.randrange(10 ** 6), r.random(), str(r.random())) for _ in range(n)]


@pytest.mark.parametrize("hot", [0, 0.4, 1])
def test_rows_at_positions(spark, hot):
    rows = _rows(1, 3000, hot)
    want = sorted(map(_key, rows), key=lambda k: [(x[0], x[1], x[2] if not isinstance(x[2], str) else x[2].encode()) for x in k])
    df = spark.createDataFrame(rows, DDL).repartition(5)
    for first, last in ((0, 2), (1499, 1503), (2998, 3000), (1700, 1701), (2990, 5000)):
        got = rows_at(df, ["a", "b", "c"], first, last, len(rows), splitters=7, few=40).orderBy("row_ix").collect()
        assert [(r.row_ix, _key(r[:3])) for r in got] == [(i, want[i]) for i in range(first, min(last, len(rows)))]
    assert rows_at(df, ["a"], 5, 5, len(rows)).count() == 0


def test_region_sample_does_not_shuffle_the_table(spark):
    df = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), "id")
    out = to.region_sample(df, ["k"], 4)
    want = sorted((r.k, r.id) for r in df.collect())
    assert sorted((r.row_ix, r.k, r.id) for r in out.collect()) == [
        (i, *want[i]) for i in (*range(4), *range(49_998, 50_002), *range(99_996, 100_000))]
    assert "rangepartitioning" not in plan_text(out)


def test_region_sample_of_an_empty_table(spark):
    out = to.region_sample(spark.createDataFrame([], DDL), ["a"])
    assert out.columns == ["a", "b", "c", "row_ix", "region"] and out.count() == 0
