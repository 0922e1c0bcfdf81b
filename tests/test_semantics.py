"""Null, tie, duplicate-key and zero-divisor rules on hand-written frames."""

import math

import pytest
from pyspark.sql import functions as F

import tableops as to


def rows(df, order=None):
    if order:
        df = df.orderBy(*order)
    return [r.asDict() for r in df.collect()]


@pytest.fixture()
def nulls_numeric(spark):
    return spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0), (2, None, 4.0, None), (3, None, None, None), (4, float("nan"), 5.0, 1.0)],
        "id int, a double, b double, c double")


def test_calc_null_rules(spark, nulls_numeric):
    df = nulls_numeric
    got = {r["id"]: r["Result"] for r in to.calc(df, "sum", ["a", "b", "c"]).collect()}
    assert got == {1: 6.0, 2: 4.0, 3: 0.0, 4: 6.0}  # all-null sums to 0; NaN read as null
    got = {r["id"]: r["Result"] for r in to.calc(df, "mean", ["a", "b", "c"]).collect()}
    assert got[1] == 2.0 and got[2] == 4.0 and got[3] is None and got[4] == 3.0
    got = {r["id"]: r["Result"] for r in to.calc(df, "min", ["a", "b", "c"]).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: None, 4: 1.0}
    got = {r["id"]: r["Result"] for r in to.calc(df, "count", ["a", "b", "c"]).collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 2}
    got = {r["id"]: r["Result"] for r in to.calc(df, "median", ["a", "b", "c"]).collect()}
    assert got == {1: 2.0, 2: 4.0, 3: None, 4: 3.0}
    got = {r["id"]: r["Result"] for r in to.calc(df, "multiply", ["a", "b"]).collect()}
    assert got[1] == 2.0 and got[2] is None
    got = {r["id"]: r["Result"] for r in to.calc(df, "variance", ["a", "b", "c"]).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None and got[4] == pytest.approx(8.0)
    got = {r["id"]: r["Result"] for r in to.calc(df, "std_dev", ["a", "b", "c"]).collect()}
    assert got[1] == pytest.approx(1.0)


def test_calc_integers_stay_integers(spark):
    df = spark.createDataFrame([(1, 2, None), (3, None, None)], "a int, b bigint, c int")
    out = to.calc(df, "sum", ["a", "b", "c"])
    assert out.schema["Result"].dataType.simpleString() == "bigint"
    assert [r.Result for r in out.collect()] == [3, 3]
    assert [r.Result for r in to.calc(df, "max", ["a", "b"]).collect()] == [2, 3]
    assert to.calc(df, "mean", ["a", "b"]).schema["Result"].dataType.simpleString() == "double"


def test_calc_text_raises(spark):
    df = spark.createDataFrame([("x", 1.0)], "t string, v double")
    with pytest.raises(TypeError):
        to.calc(df, "sum", ["t", "v"])
    with pytest.raises(ValueError):
        to.calc(df, "divide", ["v"])


def test_zero_division(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 0.0, 0.0), (3, -2.0, 0.0), (4, 6.0, 3.0)],
                               "id int, a double, b double")
    got = {r["id"]: r["Result"] for r in to.calc(df, "divide", ["a", "b"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 2.0}
    got = {r["id"]: r["Result"] for r in to.calc(df, "divide", ["a", "b"], ieee=True).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[3] == -math.inf and got[4] == 2.0
    got = {r["id"]: r["p"] for r in to.calc(df, "percentage", ["a", "b"], "p").collect()}
    assert got[4] == 200.0 and got[1] is None
    tot = {r["id"]: r["p"] for r in to.calc(df, "percentage", ["a"], "p").collect()}
    assert sum(tot.values()) == pytest.approx(100.0)


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 1.0)], "id int, v double")
    assert [r.id for r in to.sort_rows(df, "v").collect()] == [3, 1, 2]
    assert [r.id for r in to.sort_rows(df, "v", desc=True).collect()] == [1, 3, 2]


@pytest.fixture()
def dup_keys(spark):
    return spark.createDataFrame(
        [(0, "a", 1), (1, "b", 2), (2, "a", 3), (3, None, 4), (4, None, 5), (5, "c", 6)],
        "pos int, k string, v int")


def test_dedup_keep_first_null_group(spark, dup_keys):
    out = rows(to.deduplicate(dup_keys, ["k"], order_by=["pos"]), ["pos"])
    assert [r["pos"] for r in out] == [0, 1, 3, 5]


def test_lookup_last_wins_and_nulls(spark, dup_keys):
    main = spark.createDataFrame([("a",), ("b",), (None,), ("z",), ("a",)], "k string")
    out = to.lookup(main, dup_keys, "k", "v", "got", order_by=["pos"])
    assert out.count() == 5
    got = sorted((r.k or "", r.got) for r in out.collect())
    assert got == [("", 5), ("a", 3), ("a", 3), ("b", 2), ("z", None)]


def test_index_match(spark, dup_keys):
    out = to.index_match(dup_keys, "k", "v", "last_v", order_by=["pos"])
    got = {r.pos: r.last_v for r in out.collect()}
    assert got == {0: 3, 1: 2, 2: 3, 3: 5, 4: 5, 5: 6}


def test_lookup_missing_column_raises(spark, dup_keys):
    with pytest.raises(KeyError):
        to.lookup(dup_keys, dup_keys, "k", "nope", "x")


def test_join_clash_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (2, "z", 30)], "k int, name string, v int")
    b = spark.createDataFrame([(1, "X"), (None, "N"), (3, "W")], "k int, name string")
    out = to.join_tables(a, b, "k", "left")
    assert out.columns == ["k", "name_x", "v", "name_y"]
    got = sorted((r.k if r.k is not None else -1, r.name_y) for r in out.collect())
    assert got == [(-1, "N"), (1, "X"), (2, None)]
    outer = to.join_tables(a, b, "k", "outer")
    assert sorted(r.k if r.k is not None else -1 for r in outer.collect()) == [-1, 1, 2, 3]
    with pytest.raises(ValueError):
        to.join_tables(a, b, "k", "cross")


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame(
        [(1, "  John   Smith "), (2, "a\nb\tc"), (3, ""), (4, None), (5, "one"), (6, "5")],
        "id int, t string")


def test_split_and_normalize(spark, texts):
    out = {r.id: (r.first, r.second) for r in to.split_column(texts, "t", ["first", "second"]).collect()}
    assert out[1] == ("John", "Smith") and out[2] == ("a", "b") and out[3] == (None, None)
    assert out[4] == (None, None) and out[5] == ("one", None)
    norm = {r.id: r.t for r in to.normalize_text(texts, "t").collect()}
    assert norm[1] == "John Smith" and norm[2] == "a b c" and norm[4] == ""


def test_merge_fill_replace(spark, texts):
    df = texts.withColumn("n", F.lit(None).cast("int"))
    m = {r.id: r.m for r in to.merge_columns(df, ["t", "id"], "m").collect()}
    assert m[4] == " 4" and m[5] == "one 5"
    f = to.fill_missing(df, "N/A", ["t"])
    assert {r.id: r.t for r in f.collect()}[4] == "N/A"
    with pytest.raises(TypeError):
        to.fill_missing(df, "N/A", ["n"])
    assert to.fill_missing(df, "N/A", ["n"], cast=True).schema["n"].dataType.simpleString() == "string"
    r = to.replace_values(df, "5", "five")
    assert {x.id: x.t for x in r.collect()}[6] == "five"
    nums = spark.createDataFrame([(5, "5")], "a int, b string")
    assert to.replace_values(nums, "5", "x").collect()[0].a == 5  # text never matches a number


def test_filters(spark, texts):
    assert {r.id for r in to.filter_rows(texts, "t", "contains", "J.HN").collect()} == {1}
    assert {r.id for r in to.filter_rows(texts, "t", "!=", "one").collect()} == {1, 2, 3, 4, 6}
    assert {r.id for r in to.filter_rows(texts, "t", "==", "5").collect()} == {6}
    assert {r.id for r in to.filter_rows(texts, "t", "startswith", "on").collect()} == {5}
    with pytest.raises(ValueError):
        to.filter_rows(texts, "t", ">", 3)
    nums = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 7.0)], "id int, v double")
    assert {r.id for r in to.filter_rows(nums, "v", ">", 0).collect()} == {1, 4}
    assert to.filter_rows(nums, "v", "==", "abc").count() == 0
    assert to.filter_rows(nums, "v", "!=", "abc").count() == 4
    assert {r.id for r in to.filter_any_token(texts, "t", ["smith", "ONE"]).collect()} == {1, 5}
    assert {r.id for r in to.search_rows(texts, "SMI").collect()} == {1}


def test_to_numeric(spark):
    df = spark.createDataFrame([("1,234.5",), ("-",), (" 7 ",), (None,)], "s string")
    assert [r.s for r in to.to_numeric(df, "s").collect()] == [1234.5, None, 7.0, None]


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (4.0,), (9.0,), (10.0,)], "v double")
    out = [r.b for r in to.bin_values(df, "v", [0, 3, 6, 9], ["0-3", "4-6", "7-9"], "b").collect()]
    assert out == [None, "0-3", "4-6", "7-9", None]


def test_number_format(spark):
    df = spark.createDataFrame([(1234.5,), (-3.0,), (0.125,)], "v double")
    cur = [r.v for r in to.number_format(df, "v", "currency").collect()]
    assert cur[:2] == ["$1,234.50", "-$3.00"]
    pct = [r.p for r in to.number_format(df, "v", "percent", 1, out="p").collect()]
    assert pct[2] == "12.5%"


def test_group_and_pivot_nulls(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.0), (None, "x", 5.0), ("c", "y", None)],
        "k string, c string, v double")
    g = {r.k: r.v for r in to.group_by(df, "k", {"v": "sum"}).collect()}
    assert g == {"a": 1.0, "b": 2.0, "c": 0.0}  # null key dropped, all-null sum 0
    s = {r.k: r.v for r in to.group_by(df, "k", {"v": "std"}).collect()}
    assert s["a"] is None
    with pytest.raises(ValueError):
        to.group_by(df, "k", {"v": "mode"})
    pm = {r.k: (r.x, r.y) for r in to.pivot_table(df, "k", "c", "v", "mean").collect()}
    assert "c" not in pm and pm["a"] == (1.0, 0.0)  # all-null index row dropped for mean
    pc = {r.k: (r.x, r.y) for r in to.pivot_table(df, "k", "c").collect()}
    assert pc == {"a": (1, 1), "b": (1, 0), "c": (0, 1)}
    ct = {r.k: r.asDict() for r in to.cross_tab(df, "k", "c").collect()}
    assert ct["Total"]["Total"] == 4 and ct["a"]["Total"] == 2


def test_subtotals(spark):
    df = spark.createDataFrame([("b", 1, 1.0), ("a", 2, 2.0), ("b", 3, None), (None, 4, 4.0)],
                               "k string, n int, v double")
    out = to.subtotals(df, "k", order_by=["n"]).collect()
    # groups in order of first appearance, details in row order
    assert [r.k for r in out] == ["b", "b", "b - SUBTOTAL", "a", "a - SUBTOTAL"]
    assert [r.n for r in out if not r._is_subtotal] == [1, 3, 2]
    sub = {r.k: (r.n, r.v) for r in out if r._is_subtotal}
    assert sub == {"a - SUBTOTAL": (2, 2.0), "b - SUBTOTAL": (4, 1.0)}
    keyed = to.subtotals(df, "k").collect()
    assert [r.k for r in keyed] == ["a", "a - SUBTOTAL", "b", "b", "b - SUBTOTAL"]


def test_value_counts_and_summary(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    assert [(r.k, r.Count) for r in to.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    nan_keys = spark.createDataFrame([(1.0,), (float("nan"),), (1.0,), (None,)], "k double")
    assert [(r.k, r.Count) for r in to.value_counts(nan_keys, "k").collect()] == [(1.0, 2)]
    assert to.group_count(nan_keys, "k").count() == 1
    nums = spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4]], "v double")
    s = to.summary_stats(nums).collect()[0].asDict()
    assert s["Column"] == "v" and s["Count"] == 4 and s["25%"] == 1.75 and s["50%"] == 2.5


def test_rules(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, 10.0), (4, None)], "id int, v double")
    neg = {r.id: r.f for r in to.flag(df, "v", "<", 0, "f").collect()}
    assert neg == {1: True, 2: False, 3: False, 4: False}
    bar = {r.id: r.b for r in to.data_bar(df, "v", "b").collect()}
    assert bar == {1: 0.0, 2: pytest.approx(1 / 3), 3: 1.0, 4: None}
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, v double")
    assert {r.b for r in to.data_bar(flat, "v", "b").collect()} == {0.0}
    cs = {r.id: r.c for r in to.color_scale(df, "v", "c").collect()}
    assert cs[1] == "F8696B" and cs[2] == "FFEB84" and cs[3] == "63BE7B" and cs[4] is None
    cw = {r.id: r.c for r in to.color_when(df, "v", ">", 1, "c").collect()}
    assert cw == {1: None, 2: None, 3: "FFFF00", 4: None}


def test_unique_names_and_header(spark, scratch):
    assert to.unique_names(["A", "A", "A_2", "", None, "nan"]) == \
        ["A", "A_2", "A_2_2", "Column", "Column_2", "Column_3"]
    path = f"{scratch}/raw.csv"
    lines = ["Results of the term,,,", ",,,", "S. No.,Grade,Student Name,Maths",
             "1,7,Ann Lee,55", "2,7,Bo Chen,-", "3,8,\"Cy\nDee\",71"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    raw = to.read_raw(spark, path, multiLine="true")
    assert [r.row_ix for r in raw.orderBy("row_ix").collect()] == list(range(6))
    h = to.detect_header(raw)
    assert h == 2
    t = to.apply_header(raw, h)
    assert t.columns == ["S. No.", "Grade", "Student Name", "Maths"]
    assert t.count() == 3
    mixed = to.to_numeric(t, "Maths")
    assert sorted([r.Maths for r in mixed.collect()], key=lambda x: (x is None, x)) == [55.0, 71.0, None]


def test_classify_and_profile(spark):
    df = spark.createDataFrame(
        [(i, f"name{i}", "g" + str(i % 2), float(i), None) for i in range(10)],
        "id int, student string, grp string, score double, empty string")
    roles = {r.column: r.role for r in to.classify_columns(df).collect()}
    assert roles == {"id": "measure", "student": "entity", "grp": "context",
                     "score": "measure", "empty": "unknown"}
    prof = {r.column: (r.non_null, r.nulls) for r in to.profile(df).collect()}
    assert prof["empty"] == (0, 10) and prof["id"] == (10, 0)


def test_region_sample(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = sorted((r.region, r.k) for r in to.region_sample(df, ["k"], 3).collect())
    assert [k for reg, k in out if reg == "head"] == [0, 1, 2]
    assert [k for reg, k in out if reg == "middle"] == [4, 5, 6]
    assert [k for reg, k in out if reg == "tail"] == [7, 8, 9]
    small = spark.range(7).withColumnRenamed("id", "k")
    regs = {r.region for r in to.region_sample(small, ["k"], 3).collect()}
    assert regs == {"head", "tail"}


def test_intent_and_mentions(spark):
    df = spark.createDataFrame([("Show me a PIE chart",), ("only rows where x",), ("rank by score",),
                                ("average revenue",), ("max sales",), ("display all",), ("rename",)],
                               "q string")
    out = [(r.intent, r.chart_type, r.aggregation) for r in to.classify_intent(df, "q").collect()]
    assert out == [("visualization", "pie", None), ("filter", None, None), ("sort", None, None),
                   ("aggregation", None, "mean"), ("aggregation", None, None),
                   ("display", None, None), ("transform", None, None)]
    m = to.column_mentions(df, "q", ["Revenue", "score", "x"], "m").collect()
    assert m[3].m == ["Revenue"] and m[2].m == ["score"]


def test_extract_json_forms(spark):
    forms = ['{"a": 1}', 'Sure:\n```json\n{"a": 2}\n```', 'text {"a": {"b": 3}} tail',
             'x {"a": [1, {"c": {"d": 4}}]} y', 'no json at all', '{broken', None,
             'a {x} b {"k": 1}']
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, r string")
    out = {r.i: (r.json, r.json_status) for r in to.extract_json(df, "r").collect()}
    assert out[0] == ('{"a": 1}', "direct") and out[1] == ('{"a": 2}', "fenced")
    assert out[2] == ('{"a": {"b": 3}}', "pattern")
    # the one-level pattern finds the inner object first, as in the reference
    assert out[3] == ('{"c": {"d": 4}}', "pattern")
    assert out[4] == (None, "failed") and out[5] == (None, "failed") and out[6] == (None, "failed")
    assert out[7] == ('{"k": 1}', "braces")


def test_exact_median_everywhere(spark):
    import statistics
    data = [("hot", float(v)) for v in range(1, 40)] + [("a", 1.0), ("a", 4.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, v double")
    med = {r.k: r.v for r in to.group_by(df, "k", {"v": "median"}).collect()}
    assert med == {"hot": 20.0, "a": 2.5, "b": None}
    both = to.group_by(df, "k", [("v", "median", "m"), ("v", "count", "n")]).collect()
    assert {r.k: (r.m, r.n) for r in both}["a"] == (2.5, 2)
    two = df.withColumn("w", F.col("v") * 2)
    multi = {r.k: (r.m1, r.m2) for r in
             to.group_by(two, "k", [("v", "median", "m1"), ("w", "median", "m2")]).collect()}
    assert multi == {"hot": (20.0, 40.0), "a": (2.5, 5.0), "b": (None, None)}
    allv = [v for _, v in data if v is not None]
    assert to.column_stat(df, "v", "median").first().v == statistics.median(allv)
    k = {r.metric: r.value for r in to.kpi(df, {"med": ("v", "median"), "n": ("v", "count")}).collect()}
    assert k == {"med": statistics.median(allv), "n": float(len(allv))}
    piv = df.withColumn("c", F.lit("x"))
    p = {r.k: r.x for r in to.pivot_table(piv, "k", "c", "v", "median").collect()}
    assert p == {"hot": 20.0, "a": 2.5}
    cs = {(r.k, r.series): r.value for r in to.chart_series(df, "k", "v", "median").collect()}
    assert cs[("hot", "v")] == 20.0
