"""Workbook IO, output naming, audit table and the streaming runner."""

import json
import os

import pytest
from pyspark.sql import functions as F

import tableops as to
from tableops.streaming.files import read_stream, run_stream
from tests.conftest import SF_SMALL


def test_workbook_round_trip(spark, scratch):
    tables = to.read_workbook(spark, SF_SMALL, names=["region", "nation"])
    assert set(tables) == {"region", "nation"}
    out = f"{scratch}/book_modified_1"
    new_region = to.add_column(tables["region"], "note")
    to.write_workbook(tables, "region", new_region, out)
    back = to.read_workbook(spark, out)
    assert set(back) == {"region", "nation"} and "note" in back["region"].columns
    with pytest.raises(Exception):
        to.write_workbook(tables, "region", new_region, out)  # never overwrite
    assert to.next_output(spark, scratch, "book").endswith("book_modified_2")
    with pytest.raises(ValueError):
        to.write_workbook(tables, "region", new_region, SF_SMALL, source_dir=SF_SMALL)


def test_read_table_nan_to_null(spark, scratch):
    p = f"{scratch}/t.csv"
    with open(p, "w") as f:
        f.write("a,b\n1,NaN\n2,3.5\n")
    df = to.read_table(spark, p, "csv")
    assert [r.b for r in df.orderBy("a").collect()] == [None, 3.5]
    typed = to.read_table(spark, p, "csv", schema="a long, b double")
    assert typed.schema.simpleString() == "struct<a:bigint,b:double>"
    assert [r.b for r in typed.orderBy("a").collect()] == [None, 3.5]


def test_json_rows_and_preview(spark):
    o = to.read_table(spark, f"{SF_SMALL}/orders.parquet")
    j = to.json_rows(o).first().json
    d = json.loads(j)
    assert set(d) == set(o.columns) and len(d["o_orderdate"]) == 19
    p = to.preview(o, ["o_orderkey"], 10).collect()
    assert [r.o_orderkey for r in p] == sorted(r.o_orderkey for r in p) and len(p) == 10


def test_audit_append_read_export(spark, scratch):
    path = f"{scratch}/audit"
    to.audit(spark, path, "calculation.sum", source="book.xlsx", output="book_modified_1",
             rows_before=10, rows_after=10, params={"cols": ["a", "b"]})
    to.audit(spark, path, "transformation.remove_column", rows_before=10, rows_after=10)
    log = to.read_audit(spark, path)
    assert log.count() == 2
    out = to.export_audit(spark, path, f"{scratch}/audit_json")
    assert any(n.endswith(".json") for n in os.listdir(out))


def test_row_counts_and_observation(spark, scratch):
    df = spark.range(100)
    after = df.filter("id % 3 = 0")
    assert to.row_counts(df, after) == {"rows_before": 100, "rows_after": 34, "rows_affected": 66}
    obs_df, obs = to.observed_counts(after)
    obs_df.write.parquet(f"{scratch}/obs")
    assert obs.get["rows"] == 34


def test_stream_row_local_operator(spark, scratch):
    src = f"{scratch}/in"
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = read_stream(spark, src, schema, max_files_per_trigger=1)
    q = run_stream(stream, lambda d: to.flag(d, "value", ">", 100, "big"), f"{scratch}/out",
                   "events_flags", audit_path=f"{scratch}/audit", once=True,
                   checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/out")
    assert out.count() == spark.read.parquet(src).count()
    assert out.filter(F.col("big")).count() == spark.read.parquet(src).filter("value > 100").count()
    assert to.read_audit(spark, f"{scratch}/audit").count() >= 1


def test_streaming_windowed_series_matches_batch(spark, scratch):
    from tableops.streaming.windows import windowed_series
    src = f"{scratch}/events"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(4).write.parquet(src)
    stream = read_stream(spark, src, ev.schema, max_files_per_trigger=2)
    series = windowed_series(stream, "ts", "value", window="1 day", watermark="1 hour")
    q = (series.writeStream.outputMode("complete").format("memory")
         .queryName("win_series").option("checkpointLocation", f"{scratch}/wckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {r.ts: round(r.value, 6) for r in spark.table("win_series").collect()}
    want = {r.ts: round(r.value, 6) for r in to.line_series(ev, "ts", "value", bucket="day").collect()}
    assert got == want
    with pytest.raises(ValueError):
        windowed_series(stream, "ts", "value", fn="median")


def test_read_sheet_finds_or_keeps_header(spark, scratch):
    messy = f"{scratch}/messy.csv"
    with open(messy, "w") as f:
        f.write("Term results,,,\n,,,\nS. No.,Grade,Student Name,Maths\n1,7,Ann Lee,55\n2,7,Bo Chen,-\n")
    t = to.read_sheet(spark, messy)
    assert t.columns == ["S. No.", "Grade", "Student Name", "Maths"] and t.count() == 2
    clean = f"{scratch}/clean.csv"
    with open(clean, "w") as f:
        f.write("id,name,name\n1,x,y\n2,z,\n")
    c = to.read_sheet(spark, clean)
    assert c.columns == ["id", "name", "name_2"] and c.count() == 2


def test_export_summary(spark, scratch):
    li = to.read_table(spark, f"{SF_SMALL}/lineitem.parquet")
    out = to.export_summary(li.drop("l_shipdate"), "l_returnflag", f"{scratch}/summary")
    back = spark.read.parquet(out)
    assert back.count() == li.select("l_returnflag").distinct().count()
    assert back.agg(F.sum("Count")).first()[0] == li.count()
    with pytest.raises(Exception):
        to.export_summary(li, "l_returnflag", out)


def test_stream_file_sink_without_audit(spark, scratch):
    src = f"{scratch}/in2"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(2).write.parquet(src)
    stream = read_stream(spark, src, ev.schema)
    q = run_stream(stream, lambda d: to.classify_intent(d, "event_type"), f"{scratch}/out2",
                   "events_intent", once=True, checkpoint=f"{scratch}/ckpt2")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/out2")
    assert out.count() == ev.count() and "intent" in out.columns
