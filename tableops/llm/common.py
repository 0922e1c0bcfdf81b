"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableops.session import ensure_checkpoint_dir

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: ``pick(df, _id="doc_id")``. Whatever
    else the table holds cannot clash with an operator's own columns."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


def whole_text(c: str | Column) -> Column:
    """The text as a string, NULL as the empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used.

    A lambda variable is the one name that neither projection collapsing nor a nested
    lambda replaces by the expression behind it."""
    return F.transform(F.array(value), body)[0]


def wide_key(text: Column) -> list[Column]:
    """128 bits that name a text: two independently seeded 64-bit hashes."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5EED), text)]


def by_value(module: str) -> None:
    """Send this module's functions to executors inside the task, not by import name, so
    that they run where the package is not installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder, for the tables that an operator writes on
    its way."""
    return f"{ensure_checkpoint_dir(spark)}/work-{uuid.uuid4()}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as a table below ``folder`` and read again: cuts the lineage as a
    checkpoint does, but compressed, and with a size that Spark knows."""
    spark = df.sparkSession
    path = f"{folder or work_folder(spark)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that are broadcast at most: some 20 MB as a hash table.
SMALL = 200_000


def checked_broadcast(df: DataFrame, folder: str | None = None, limit: int = SMALL) -> DataFrame:
    """``df`` (rows of a few numbers), written and counted; marked for broadcast up to
    ``limit`` rows, else left to a shuffled join."""
    df = written(df, folder)
    return F.broadcast(df) if df.count() <= limit else df


#: Longs of bits in a row of a filter, and keys that share a row: of other keys, one of 20 passes.
FILTER_LONGS, FILTER_KEYS = 16, 128


class Keys(NamedTuple):
    """A written table of ``columns`` (longs, no NULL) and what goes with them. Up to SMALL rows
    are broadcast; of more, ``bits`` (``_block``, ``_bits``; ``blocks`` rows) is, if it is small."""

    rows: DataFrame
    columns: Sequence[str]
    blocks: int
    bits: DataFrame | None


def _spots(columns: Sequence[str]) -> tuple[Column, list[Column]]:
    """A key's hash without its upper bits, and its two places among the bits of a row."""
    h = F.xxhash64(*columns)
    last = F.lit(64 * FILTER_LONGS - 1)
    return h.bitwiseAND(F.lit((1 << 40) - 1)), [F.shiftrightunsigned(h, k).bitwiseAND(last).cast("int") for k in (40, 50)]


def _bit(spot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)))


def keys(df: DataFrame, columns: Sequence[str], folder: str | None = None, limit: int | None = None) -> Keys:
    """``df`` written and counted, for ``thin`` and ``meet``; ``limit`` is the most rows to broadcast."""
    limit = SMALL if limit is None else limit
    df = written(df, folder)
    n = df.count()
    if n <= limit:
        return Keys(F.broadcast(df), columns, 0, None)
    blocks = -(-n // FILTER_KEYS)
    if blocks > SMALL:
        return Keys(df, columns, 0, None)
    low, spots = _spots(columns)
    each = df.select((low % F.lit(blocks)).alias("_block"), F.explode(F.array(*spots)).alias("_spot"))
    bits = each.groupBy("_block").agg(*[
        F.bit_or(F.when(F.shiftright("_spot", 6) == k, _bit(F.col("_spot"))).otherwise(F.lit(0).cast("long"))).alias(f"_{k}") for k in range(FILTER_LONGS)])
    return Keys(df, columns, blocks, written(bits.select("_block", F.array(*[f"_{k}" for k in range(FILTER_LONGS)]).alias("_bits")), folder))


def _told(rows: DataFrame, columns: Sequence[str], few: Keys) -> DataFrame:
    """``rows`` plus ``_in``, false for most of those whose ``columns`` are no key of ``few`` and for none whose are."""
    low, (one, two) = _spots(columns)
    held = rows.select(*rows.columns, (low % F.lit(few.blocks)).alias("_at_block"), one.alias("_one"), two.alias("_two")) \
        .join(F.broadcast(few.bits), F.col("_at_block") == F.col("_block"), "left")
    both = " and ".join(f"get(_bits, shiftright({x}, 6)) & shiftleft(1L, {x} & 63) != 0" for x in ("_one", "_two"))
    return held.select(*rows.columns, F.expr(f"coalesce({both}, false)").alias("_in"))


def thin(rows: DataFrame, columns: Sequence[str], few: Keys) -> DataFrame:
    """``rows`` with all those whose ``columns`` are a key of ``few``, and none, some or all of the others:
    for a join that follows, which then moves fewer. Nothing is shuffled."""
    return rows if few.bits is None else _told(rows, columns, few).filter("_in").drop("_in")


def _equal(columns: Sequence[str], few: Keys) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(columns, few.columns)])


def meet(rows: DataFrame, columns: Sequence[str], few: Keys) -> DataFrame:
    """Inner join of ``rows`` with ``few`` where ``columns`` are its key."""
    return thin(rows, columns, few).join(few.rows, _equal(columns, few))


def meet_first(rows: DataFrame, columns: Sequence[str], few: Keys, value: str) -> DataFrame:
    """For each key of ``few`` that ``rows`` have as ``columns``: ``columns`` and the first ``value``. Equal keys
    are combined before the shuffle, and what is not broadcast is joined where it then lies."""
    first = lambda df: df.groupBy(*columns).agg(F.first(value).alias(value))
    if few.bits is None:
        return first(meet(rows, columns, few))
    return first(thin(rows, columns, few)).join(few.rows, _equal(columns, few), "left_semi")


def meet_left(rows: DataFrame, columns: Sequence[str], few: Keys, also: Column | None = None) -> DataFrame:
    """Left join of ``rows`` with ``few`` where ``columns`` are its key and ``also`` holds; rows that the
    bits tell to have no key are not shuffled."""
    equal = _equal(columns, few) if also is None else _equal(columns, few) & also
    if few.bits is None:
        return rows.join(few.rows, equal, "left")
    told = _told(rows, columns, few)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in few.rows.schema]
    return told.filter("_in").drop("_in").join(few.rows, equal, "left") \
        .unionByName(told.filter("not _in").select(*rows.columns, *none))


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks. (Globals of
    functions sent by value are made anew for each task.)"""
    return vars(sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")))


def portions(batch: pa.RecordBatch, column: int, characters: int) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in portions of about ``characters``, each with its first row."""
    start, texts, size = 0, [], 0
    for k, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= characters:
            yield start, texts
            start, texts, size = k + 1, [], 0
    if texts:
        yield start, texts


def block_offsets(df: DataFrame, block: str, sums: Sequence[str]) -> DataFrame:
    """Per block the sums of all earlier blocks: columns ``_b`` and ``_before_<sum>``.

    The window without keys sees one row a block, and callers derive ``block`` from a
    fixed number of hash bits."""
    totals = df.groupBy(F.col(block).alias("_b")).agg(*[F.sum(s).alias(s) for s in sums])
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_b", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_before_{s}")
                                 for s in sums])


by_value(__name__)
