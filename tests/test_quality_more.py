"""Semantics of validation rules, rollups, sparklines and column transforms on
hand-written frames with NULLs and blanks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tableops as to


@pytest.fixture()
def cells(spark):
    return spark.createDataFrame(
        [(1, "12", "short", "A"), (2, "x", "a much longer text", None), (3, None, "  ", "B"),
         (4, "-5", None, "A"), (5, "150", "ok", "")],
        "id int, num string, txt string, grp string")


def test_range_length_blank_type_rules(spark, cells):
    r = {(x.row_key, x.value) for x in to.check_range(cells, "num", 0, 100, key="id").collect()}
    assert r == {("2", "x"), ("4", "-5"), ("5", "150")}  # text that is no number fails; blank passes
    lo = {x.row_key for x in to.check_range(cells, "num", lo=0, key="id").collect()}
    assert lo == {"2", "4"}
    ln = {x.row_key for x in to.check_length(cells, "txt", 5, key="id").collect()}
    assert ln == {"2"}  # blank and NULL pass
    bl = sorted((x.column, x.row_key) for x in to.check_blank(cells, ["txt", "grp"], key="id").collect())
    assert bl == [("grp", "2"), ("grp", "5"), ("txt", "3"), ("txt", "4")]
    ty = {x.row_key for x in to.check_type(cells, "num", "int", key="id").collect()}
    assert ty == {"2"}


def test_quality_report_counts(spark, cells):
    rep = {(r.rule, r.column): (r.checked, r.failed) for r in to.quality_report(cells, [
        to.in_range("num", 0, 100), to.blank("grp"), to.unique("grp"), to.allowed("grp", "A;B")]).collect()}
    assert rep[("range_check", "num")] == (5, 3)
    assert rep[("blank_check", "grp")] == (5, 2)
    assert rep[("no_duplicates", "grp")] == (5, 2)  # the two 'A' rows
    assert rep[("dropdown", "grp")] == (5, 0)
    with pytest.raises(ValueError):
        to.quality_report(cells, [])
    blanks = spark.createDataFrame([("",), (" ",), (None,), (None,)], "g string")
    assert to.check_unique(blanks, "g").count() == 0  # blanks never count as duplicates


def test_rollup_levels(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "k string, s string, v double")
    out = {(r.k, r.s, r.level): r.v for r in to.rollup_totals(df, ["k", "s"], ["v"]).collect()}
    assert out[("a", "x", 0)] == 1.0 and out[("a", None, 1)] == 3.0 and out[(None, None, 3)] == 7.0
    med = {(r.k, r.s, r.level): r.v for r in to.rollup_totals(df, ["k", "s"], ["v"], "median").collect()}
    assert med[("a", None, 1)] == 1.5 and med[(None, None, 3)] == 2.0 and med[("b", "x", 0)] == 4.0
    assert set(med) == set(out)


def test_sparkline_is_bucketed_and_ordered(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2024, 1, 2, 5), 2.0), (1, t(2024, 1, 1, 9), 1.0),
                                (1, t(2024, 1, 1, 10), 3.0), (2, t(2024, 1, 3), 7.0), (None, t(2024, 1, 3), 1.0)],
                               "u long, ts timestamp, v double")
    got = {r.u: (r.series, len(r.series_x)) for r in to.sparkline(df, "u", "ts", "v").collect()}
    assert got == {1: ([4.0, 2.0], 2), 2: ([7.0], 1)}


def test_select_rename_drop(spark, cells):
    assert to.select_as(cells, {"id": "key", "txt": "text"}).columns == ["key", "text"]
    assert "label" in to.rename_column(cells, "grp", "label").columns
    with pytest.raises(KeyError):
        to.rename_column(cells, "nope", "x")
    assert [r.id for r in to.drop_missing(cells, ["num", "txt"]).orderBy("id").collect()] == [1, 2, 5]
    assert "txt" not in to.remove_column(cells, ["txt", "missing"]).columns


def test_profile_and_data_profile(spark, cells):
    p = {r.column: (r.kind, r.non_null) for r in to.profile(cells).collect()}
    assert p["num"] == ("text", 4) and p["id"] == ("numeric", 5)
    d = {r.column: r.asDict() for r in to.data_profile(cells).collect()}
    assert d["grp"]["top"] == "A" and d["grp"]["top_count"] == 2
    assert d["id"]["50%"] == 3.0 and d["num"]["Mean"] is None
