"""Rows at given positions of a sort order, without sorting the table.

1. a sample of SPLITTERS rows (a top-n of random numbers, kept by each task) gives split
   points, written to the shared checkpoint folder so that all later passes see the same;
2. one aggregation counts the rows between split points and the rows equal to each;
3. the running sum of those counts (at most 2 x SPLITTERS + 1 numbers, on the driver) names the
   blocks that hold the wanted positions, and only these are read again: sorted if they
   hold few rows, else split anew.

Rows equal to a split point are a block of their own, in which all rows are alike, so that
a hot key never keeps a block from getting smaller. No row of the table is shuffled but those
of the last small blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.plans.lineage import cut_lineage

#: Split points a round, and rows that are sorted in one go.
SPLITTERS, FEW_ROWS = 255, 20_000


def order_key(names: Sequence[str]) -> Column:
    """One comparable value a row: ascending by ``names``, NULL last."""
    return F.struct(*[c for n in names for c in (F.col(n).isNull(), F.col(n))])


def _numbered(rows: DataFrame, names: Sequence[str], first: int, last: int, offset: int, out: str) -> DataFrame:
    """Positions ``first`` to ``last`` (exclusive) of few rows, the least of which is at ``offset``."""
    order = [F.col(n).asc_nulls_last() for n in names]
    top = rows.orderBy(*order).limit(last - offset)
    at = F.row_number().over(Window.orderBy(*order)) + F.lit(offset - 1)
    return top.withColumn(out, at.cast("long")).filter(F.col(out) >= first)


def _block(splits: Column, key: Column, steps: Sequence[int]) -> Column:
    """2 x (split points below the key), plus 1 if the key is a split point; by bisection."""
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda a, s: F.when(
        F.try_element_at(splits, a + s) < key, a + s).otherwise(a))
    return below * 2 + F.when(F.try_element_at(splits, below + 1) == key, 1).otherwise(0)


def _within(splits: Column, key: Column, first: int, last: int) -> Column:
    """Whether the key's block is one of ``first`` to ``last``, from the split points around them."""
    low, high = first // 2, F.try_element_at(splits, F.lit(last // 2 + 1))
    above = key >= F.try_element_at(splits, F.lit(low + 1)) if first % 2 else (
        key > F.try_element_at(splits, F.lit(low)) if low else F.lit(True))
    return above & (key <= high if last % 2 else F.coalesce(key < high, F.lit(True)))


def rows_at(df: DataFrame, names: Sequence[str], first: int, last: int, total: int, out: str = "row_ix",
            splitters: int = SPLITTERS, few: int = FEW_ROWS) -> DataFrame:
    """The rows at positions ``first`` to ``last`` (exclusive, 0-based) of ``df``'s ``total``
    rows in ascending order of ``names`` (NULL last), with their position as ``out``.

    ``last - first`` is meant to be small. Rows equal in ``names`` are interchangeable. The
    table is read once or twice a round, and a round divides the rows by up to ``splitters``."""
    spark = df.sparkSession
    pieces = []

    def search(rows: DataFrame, count: int, offset: int, lo: int, hi: int) -> None:
        if count <= few:
            pieces.append(_numbered(rows, names, lo, hi, offset, out))
            return
        wanted = min(splitters, max(7, 4 * count // few))
        drawn = rows.orderBy(F.rand()).limit(wanted).select(order_key(names).alias("_key"))
        splits = cut_lineage(drawn.agg(F.sort_array(F.collect_set("_key")).alias("_splits")))
        # one row of at most ``splitters`` keys
        keyed = rows.withColumn("_key", order_key(names)).crossJoin(F.broadcast(splits))
        points, key = F.col("_splits"), F.col("_key")
        steps = [1 << k for k in reversed(range(wanted.bit_length()))]
        placed = keyed.select(_block(points, key, steps).alias("_block"))
        counts = {r["_block"]: r["count"] for r in placed.groupBy("_block").count().collect()}
        held, at = [], offset
        for block in sorted(counts):
            if at < hi and at + counts[block] > lo:
                held.append((block, at))
            at += counts[block]
        start = held[0][1]
        if sum(counts[b] for b, _ in held) <= few:
            some = keyed.filter(_within(points, key, held[0][0], held[-1][0])).drop("_splits", "_key")
            pieces.append(_numbered(some, names, lo, hi, start, out))
            return
        for block, begin in held:
            left, right = max(lo, begin), min(hi, begin + counts[block])
            some = keyed.filter(_within(points, key, block, block)).drop("_splits", "_key")
            if block % 2:  # all alike
                pieces.append(_numbered(some.limit(right - left), names, left, right, left, out))
            else:
                search(some, counts[block], begin, left, right)

    first, last = max(first, 0), min(last, total)
    if first >= last:
        return spark.createDataFrame([], df.schema).withColumn(out, F.lit(0).cast("long"))
    search(df, total, 0, first, last)
    return reduce(DataFrame.unionByName, pieces)
