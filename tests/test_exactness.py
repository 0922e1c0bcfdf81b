"""Large integers, NaN, casts, JSON edge cases and quantiles that hold without exchange reuse."""

import statistics

import pytest
from pyspark.sql import functions as F

import tableops as to
from tableops.plans.inspect import pushed_filters
from tableops.plans.quantiles import exact_quantiles
from tests.conftest import SF_SMALL

BIG = 1 << 53


@pytest.mark.parametrize("op,want", [("==", [1]), ("!=", [0, 2]), (">", [2]), (">=", [1, 2]), ("<", [0]), ("<=", [0, 1])])
def test_large_integers_compare_exactly(spark, op, want):
    df = spark.createDataFrame([(BIG + i,) for i in range(3)], "id long")
    assert sorted(r.id - BIG for r in to.filter_rows(df, "id", op, BIG + 1).collect()) == want


@pytest.mark.parametrize("op,value,want", [(">", 1.5, [2]), (">=", 1.5, [2]), ("<", 1.5, [0, 1]), ("<=", 1.5, [0, 1]), ("==", 1.5, []),
                                           ("!=", 1.5, [0, 1, 2]), (">", 1e30, []), ("<", 1e30, [0, 1, 2]), ("==", "1", [1]),
                                           (">", float("-inf"), [0, 1, 2]), ("<", float("nan"), [])])
def test_bounds_that_no_integer_holds(spark, op, value, want):
    df = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    assert sorted(r.id for r in to.filter_rows(df, "id", op, value).collect()) == want


def test_integer_bounds_reach_the_scan(spark):
    li = to.read_table(spark, f"{SF_SMALL}/lineitem.parquet")
    assert "GreaterThanOrEqual(l_orderkey,100)" in pushed_filters(to.filter_rows(li, "l_orderkey", ">=", 100))[0]


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 2.0), ("b", nan), ("a", None), ("c", 1.0)], "k string, v double")
    assert [r.v for r in to.sort_rows(df, "v", desc=True).limit(2).collect()] == [2.0, 1.0]
    assert to.top_k(df, "v", 1).first().v == 2.0
    assert {r.k: r.share for r in to.pie_shares(df, "k", "v").collect()}["a"] == pytest.approx(66.7)
    assert {r.column: r.unique_ratio for r in to.classify_columns(df).collect()}["v"] == 0.5


def test_values_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(1,), (None,)], "i int")
    with pytest.raises(TypeError):
        to.fill_missing(df, 0.5, ["i"])
    with pytest.raises(TypeError):
        to.replace_values(df, 1, 1.5)
    assert to.fill_missing(df, 2.0, ["i"]).orderBy("i").collect()[1].i == 2


def test_number_text(spark):
    texts = ["5D", "7f", "1,234.5", " -2e3 ", "x", "", ".5", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in to.to_numeric(df, "t").orderBy("i").collect()]
    assert got == [None, None, 1234.5, -2000.0, None, None, 0.5, None]


def test_json_nested_too_deeply_fails_alone(spark):
    df = spark.createDataFrame([(0, "[" * 100_000), (1, '{"a": NaN}'), (2, 'x {y} {"a": 1} }'), (3, "```json\n[1]\n```")], "i int, t string")
    got = [(r.json, r.json_status) for r in to.extract_json(df, "t").orderBy("i").collect()]
    assert got == [(None, "failed"), (None, "failed"), ('{"a": 1}', "braces"), ("[1]", "fenced")]


def test_quantiles_of_a_large_group_without_exchange_reuse(spark):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000).selectExpr("if(id % 10 = 0, 'x', 'hot') k", "cast(pmod(xxhash64(id), 100000) as double) v")
        got = {r.k: r.q0 for r in exact_quantiles(df, "v", [0.5], by=["k"]).collect()}
        rows = df.collect()
        assert got == {k: statistics.median(r.v for r in rows if r.k == k) for k in ("x", "hot")}
        wide = spark.range(5000).select("id", F.create_map(F.lit("a"), "id").alias("m"))
        assert [r.row_ix for r in to.region_sample(wide, ["id"], 3).orderBy("row_ix").collect()] == [0, 1, 2, 2499, 2500, 2501, 4997, 4998, 4999]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
