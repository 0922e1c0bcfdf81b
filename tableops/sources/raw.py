"""Raw (headerless, all-text) sheets and a distributed row index.

Spark rows have no position. ``with_row_index`` gives every row its 0-based rank in
an order without a single-partition window:

1. sort (range exchange) or keep the file order, then checkpoint to the shared
   checkpoint directory so partition layout and in-partition order are frozen even
   if executors are lost;
2. count rows per partition (one small job, one number per partition);
3. rank = partition offset + position inside the partition, where the position is
   the low 33 bits of ``monotonically_increasing_id``; offsets join as a broadcast
   table with one row per partition (its size is the partition count).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list
from tableops.plans.lineage import cut_lineage
from tableops.plans.shipping import by_value

_LOW33 = (1 << 33) - 1


def with_row_index(df: DataFrame, order_by: Sequence[str | Column] | None = None,
                   name: str = "row_ix") -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_by`` (or in the current
    physical order, e.g. file order, when ``order_by`` is None)."""
    spark = df.sparkSession
    if order_by:
        cols = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in as_list(order_by)]
        df = df.orderBy(*cols)
    staged = cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id()))
    staged = staged.withColumn("_pid", F.spark_partition_id())
    counts = staged.groupBy("_pid").count().collect()  # one row per partition
    offsets, run = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], run))
        run += r["count"]
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    out = (staged.join(F.broadcast(off), "_pid")
           .withColumn(name, F.col("_off") + F.expr(f"_mid & {_LOW33}"))
           .drop("_pid", "_off", "_mid"))
    return out


def read_raw(spark: SparkSession, path: str, name: str = "row_ix", **options) -> DataFrame:
    """A CSV sheet read without a header: every column is text (``_c0``, ``_c1``...) and
    ``row_ix`` is the 0-based row position, files in the order of their names.

    Quoted cells may hold line breaks, so a file is read by one task (many files are read in
    parallel) and its rows keep the file's order; ``read_raw_blocks`` reads a large file in
    blocks. With ``multiLine="false"`` cells hold no line breaks and Spark splits files. A count
    per file and split gives the offsets: one row each, and no sort or checkpoint of the data."""
    opts = {"header": "false", "inferSchema": "false", "multiLine": "true", **options}
    df = spark.read.options(**opts).csv(path)
    cols = df.columns
    # a task reads whole splits one after another, so positions ascend within a split
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                         "_pos": F.monotonically_increasing_id()})
    splits = df.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    starts = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return df.join(starts, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))).select(
        *cols, (F.col("_off") + F.col("_pos") - F.col("_first")).alias(name))


# --- S2: one file in many blocks ---------------------------------------------------

def _block_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Lines (text, file, block start, ...) in their order, as (whether a block begins, the
    batch's part that lies in one block, whether a quote is open after each of its lines when
    none is before the block)."""
    block, inside = None, 0
    for batch in batches:
        files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        cut = [k for k in range(batch.num_rows) if k == 0 or (files[k], starts[k]) != (files[k - 1], starts[k - 1])]
        for a, b in zip(cut, [*cut[1:], batch.num_rows]):
            begins = (files[a], starts[a]) != block
            if begins:
                block, inside = (files[a], starts[a]), 0
            part = batch.slice(a, b - a)
            quotes = pc.count_substring(part.column(0), '"').to_numpy(zero_copy_only=False)
            is_open = (inside + np.cumsum(quotes)) % 2
            inside = int(is_open[-1])
            yield begins, part, is_open


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its quotes modulo 2, and the records that end in it if no quote (``even``)
    or one (``odd``) is open before it. A blank line outside quotes is no record."""
    block, facts = None, [0, 0, 0]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*block, *facts)], names=["file", "start", "quotes", "even", "odd"])
    for begins, part, is_open in _block_lines(batches):
        if begins:
            if block:
                yield row()
            block, facts, last = (part.column(1)[0].as_py(), part.column(2)[0].as_py()), [0, 0, 0], 0
        was_open = np.concatenate([[last], is_open[:-1]])
        blank = _blank(part.column(0))
        facts[1] += int(((is_open == 0) & ~(blank & (was_open == 0))).sum())
        facts[2] += int(((is_open == 1) & ~(blank & (was_open == 1))).sum())
        facts[0] = last = int(is_open[-1])
    if block:
        yield row()


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (text, file, block start, records that ended before the block, whether a quote is
    open before it) to pieces of records: file, record number, block start, whether it is a
    whole record, text. Only the first and the last piece of a block may not be whole."""
    kept: list[str] = []
    state = None

    def rows(pieces):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*pieces), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["file", "ix", "start", "whole", "text"])
    for begins, part, is_open in _block_lines(batches):
        pieces = []
        if begins:
            if kept:
                pieces.append((*state[:3], False, "\n".join(kept)))
            before, odd = part.column(3)[0].as_py(), part.column(4)[0].as_py()
            state = [part.column(1)[0].as_py(), before, part.column(2)[0].as_py(), odd == 0]
            kept = []
        for line, o in zip(part.column(0).to_pylist(), (is_open + odd) % 2):
            if not kept and not o and line in ("", "\r") and state[3]:
                continue
            kept.append(line)
            if not o:
                pieces.append((*state[:3], state[3], "\n".join(kept)))
                kept, state[3] = [], True
                state[1] += 1
        if pieces:
            yield rows(pieces)
    if kept:
        yield rows([(*state[:3], False, "\n".join(kept))])


def read_raw_blocks(spark: SparkSession, path: str, name: str = "row_ix", sep: str = ",") -> DataFrame:
    """S2 for files of any size: as ``read_raw`` with the escape character ``"``, but a file is
    read in blocks, by many tasks, although quoted cells may hold line breaks.

    Where a block begins in the middle of a quoted cell cannot be seen from the block alone.
    A first pass counts each block's quotes and the records that end in it for both cases; running
    sums over a file's blocks (one row a block) tell which case holds and how many records ended
    before. A second pass cuts the records; those that lie across a border come in pieces, put
    together by record number. Quotes stand around cells, or doubled inside quoted ones; lines
    end with LF or CR LF. Blank lines outside quotes are no rows. An empty file has none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    facts = cut_lineage(lines.mapInArrow(_block_facts, "file string, start long, quotes long, even long, odd long"))
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("odd_before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    facts = facts.withColumn("ended", F.when(F.col("odd_before") == 0, F.col("even")).otherwise(F.col("odd")))
    facts = facts.withColumn("before", F.coalesce(F.sum("ended").over(earlier), F.lit(0)))
    blocks = facts.select(F.col("file").alias("_f"), F.col("start").alias("_s"), "before", "odd_before")
    # one row for each block of a file (128 MB each by default), so that lines keep their order
    known = lines.join(F.broadcast(blocks), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))) \
        .select("value", "file", "start", "before", "odd_before")
    pieces = cut_lineage(known.mapInArrow(_block_records, "file string, ix long, start long, whole boolean, text string"))
    across = pieces.filter(~F.col("whole")).groupBy("file", "ix").agg(
        F.sort_array(F.collect_list(F.struct("start", "text"))).alias("_p"), F.count(F.lit(1)).alias("_n"))
    joined = across.select("file", "ix", F.array_join(F.col("_p.text"), "\n").alias("text"))
    records = pieces.filter("whole").select("file", "ix", "text").unionByName(joined) \
        .withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    first = records.orderBy("file", "ix").select("text").limit(1).collect()
    if not first:
        return records.select(F.col("ix").alias(name))
    width = len(next(csv.reader(io.StringIO(first[0].text, newline=""), delimiter=sep)))
    columns = [f"_c{k}" for k in range(width)]
    before_file = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = pieces.groupBy(F.col("file").alias("_f")).agg((F.max("ix") + 1).alias("_n")) \
        .select("_f", F.coalesce(F.sum("_n").over(before_file), F.lit(0)).alias("_off"))
    cells = F.from_csv("text", ", ".join(f"{c} string" for c in columns),
                       {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    return records.join(files, F.col("file") == F.col("_f")).select(cells.alias("_row"), (F.col("_off") + F.col("ix")).alias(name)) \
        .select(*[F.col(f"_row.{c}") for c in columns], name)


# Fixed value: share of blank first-row cells above which the header row is searched
# for (the reference's ``Unnamed:`` ratio test).
UNNAMED_SHARE = 0.3


def read_sheet(spark: SparkSession, path: str, **options) -> DataFrame:
    """S1 + H1-H3 for a spreadsheet export: read the CSV without a header; when more
    than 30% of the first row's cells are blank (what pandas would name
    ``Unnamed: i``), find the header among the first 10 rows (H1), else use the first
    row; then name the columns from it (H2/H3) and keep the rows below it. Only the
    first rows reach the driver."""
    from tableops.operators.profile import apply_header, detect_header
    raw = read_raw(spark, path, **options)
    cols = [c for c in raw.columns if c != "row_ix"]
    first = raw.filter(F.col("row_ix") == 0).select(*cols).collect()
    if not first:
        return raw.drop("row_ix")
    blank = sum(1 for v in first[0] if v is None or str(v).strip() == "")
    header = detect_header(raw) if cols and blank / len(cols) > UNNAMED_SHARE else 0
    return apply_header(raw, header)


by_value(__name__)
