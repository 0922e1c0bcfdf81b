"""Roles and most frequent values from sketches against exact counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tableops as to
from tableops.plans.inspect import plan_text


@pytest.mark.parametrize("distinct", [1, 2900, 2999, 3000, 3001, 3100, 4900, 4999, 5000, 5001, 5100, 9000])
def test_roles_near_the_thresholds(spark, distinct):
    part = F.pmod("id", F.lit(distinct)).cast("string")
    df = spark.range(10_000).select(part.alias("plain"), part.alias("user_name"), part.alias("user_type"), "id",
                                    F.lit(None).cast("string").alias("none"), F.current_date().alias("day"),
                                    F.array(part).alias("list"))
    want = {r.column: r.role for r in to.classify_columns(df).collect()}
    assert {r.column: r.role for r in to.column_roles(df).collect()} == want


def test_roles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert sorted(map(tuple, to.column_roles(df).collect())) == [("a", "unknown"), ("b", "unknown")]


@pytest.mark.parametrize("tracked", [32, 10_000])
def test_top_values(spark, tracked):
    r = random.Random(3)
    rows = [(r.choice([None, "hot", "hot", str(i % 700)]), r.randrange(4000), float(r.choice([1, 2, 2.5, float("nan")])),
             "tie" + str(i % 5), None, str(i), "x" * 50_000 + str(i % 3 % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b int, c double, d string, e string, f string, long string").repartition(7)
    got = {x.column: (x.top, x.top_count) for x in to.top_values(df, tracked).collect()}
    want = {}
    for c in df.columns:
        n = Counter(x.v for x in df.select(F.col(c).cast("string").alias("v")).collect() if x.v is not None)
        if n:
            want[c] = min(n.items(), key=lambda x: (-x[1], x[0]))
    assert got == want


def test_top_values_count_only_what_may_be_best(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("v"))
    out = to.top_values(df)
    assert [tuple(x) for x in out.collect()] == [("v", "7", df.filter("v = 7").count())]
    assert "xxhash64" in plan_text(out)
