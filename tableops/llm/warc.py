"""Fixity audit of WARC replicas with Merkle trees.

An archive's records are ordered by offset. A tree's leaves are record digests; a node of
level 1 is the digest of the records that begin in one range of BLOCK bytes, and a node above
that of FANOUT ranges below it, up to one root an archive. Ranges are places in the file, so
that a node's number is a division of an offset: no ranking, and a third of all records in
one archive are as many ranges, grouped like any others.

An audit compares the roots of two replicas, then only the children of nodes that differ,
level by level, and at last the records of the differing ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.common import checked_broadcast, pick
from tableops.plans.lineage import cut_lineage

BLOCK = 1 << 18
FANOUT = 16
#: Parts of an archive whose records are laid out by separate tasks.
PARTS = 256


def record_text(key: Column, url: Column, payload: Column) -> Column:
    """A response record: header lines, a blank line, the payload and two line ends. NULLs
    are written as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: "), F.coalesce(key.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame) -> DataFrame:
    """``records`` (``archive``, ``key``, ``length``, ``digest``) plus ``offset``: an archive's
    records stand one after another by digest, then key. Offsets are running sums within PARTS
    parts of an archive plus the sums of the parts before."""
    part = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")
    rows = cut_lineage(records.withColumn("_part", part))
    sums = rows.groupBy("archive", "_part").agg(F.sum("length").alias("_sum"))
    before = Window.partitionBy("archive").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    starts = sums.select(F.col("archive").alias("_a"), F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("archive", "_part").orderBy("digest", "key").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(
        starts, (F.col("archive") == F.col("_a")) & (F.col("_part") == F.col("_p"))).select(
        "archive", "key", (F.col("_start") + F.col("_in")).alias("offset"), "length", "digest")


def _parents(children: DataFrame, place: Column) -> DataFrame:
    """(``archive``, ``node``, ``digest``) of the ranges ``place`` over rows (``archive``, ``at``,
    ``digest``); a range holds FANOUT nodes, or the records that begin in BLOCK bytes."""
    parts = F.sort_array(F.collect_list(F.struct("at", "digest")))
    text = F.array_join(F.transform(parts, lambda c: F.concat_ws(":", c["at"], c["digest"])), ",")
    return children.groupBy("archive", place.alias("node")).agg(F.sha2(text, 256).alias("digest"))


def merkle_levels(records: DataFrame, levels: int) -> list[DataFrame]:
    """Node tables from level 1 up to ``levels``; the last has one root an archive."""
    at = F.col("at")
    tree = [cut_lineage(_parents(records.select("archive", F.col("offset").alias("at"), F.concat_ws(
        ":", "length", "digest").alias("digest")), F.floor(at / BLOCK)))]
    for _ in range(levels - 1):
        tree.append(cut_lineage(_parents(tree[-1].withColumnRenamed("node", "at"), F.floor(at / FANOUT))))
    return tree


def _height(*replicas: DataFrame) -> int:
    """Levels at which every archive has one node."""
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in replicas]
    nodes, levels = max(ends) // BLOCK, 1
    while nodes:
        nodes, levels = nodes // FANOUT, levels + 1
    return levels


def _unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``archive``, ``node``) of nodes whose digests differ or that one side lacks."""
    r = right.select(F.col("archive").alias("_a"), F.col("node").alias("_n"), F.col("digest").alias("_d"))
    return left.join(r, (F.col("archive") == F.col("_a")) & (F.col("node") == F.col("_n")), "full") \
        .filter(~F.col("digest").eqNullSafe(F.col("_d"))) \
        .select(F.coalesce("archive", "_a").alias("archive"), F.coalesce("node", "_n").alias("node"))


def _below(rows: DataFrame, nodes: DataFrame, place: Column) -> DataFrame:
    """The rows that lie in one of ``nodes``."""
    n = nodes.select(F.col("archive").alias("_wa"), F.col("node").alias("_wn"))
    return rows.join(n, (F.col("archive") == F.col("_wa")) & (place == F.col("_wn")), "left_semi")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per record that two replicas do not share: ``archive``, ``offset``, ``state``
    (``changed``, ``missing`` in ``right`` or ``extra`` there), ``left_digest``, ``right_digest``.

    Both sides have ``archive``, ``offset``, ``length`` and ``digest``; other columns are passed
    over. A NULL archive counts as the empty name, and rows without an offset are no records.
    Rows that one side holds several times at the same offset are compared as the sorted list
    of their digests. Two empty or equal replicas give no row."""
    sides = []
    for side in (left, right):
        s = pick(side, archive="archive", offset="offset", length="length", digest="digest").filter("offset IS NOT NULL")
        sides.append(cut_lineage(s.withColumns({"archive": F.coalesce("archive", F.lit("")),
                                                "digest": F.coalesce("digest", F.lit("")),
                                                "length": F.coalesce("length", F.lit(0))})))
    levels = _height(*sides)
    trees = [merkle_levels(s, levels) for s in sides]
    bad = _unequal(trees[0][-1], trees[1][-1])
    for level in range(levels - 2, -1, -1):
        bad = checked_broadcast(bad)
        place = F.floor(F.col("node") / FANOUT)
        bad = _unequal(*[_below(t[level], bad, place) for t in trees])
    bad = checked_broadcast(bad)
    a, b = [_below(s, bad, F.floor(F.col("offset") / BLOCK)).groupBy("archive", "offset").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "length", "digest"))), ",").alias("_all"),
        F.min("digest").alias("digest")) for s in sides]
    b = b.select(F.col("archive").alias("_a"), F.col("offset").alias("_o"), F.col("_all").alias("_ball"), F.col("digest").alias("_d"))
    both = a.join(b, (F.col("archive") == F.col("_a")) & (F.col("offset") == F.col("_o")), "full") \
        .filter(~F.col("_all").eqNullSafe(F.col("_ball")))
    state = F.when(F.col("_all").isNull(), "extra").when(F.col("_ball").isNull(), "missing").otherwise("changed")
    return both.select(F.coalesce("archive", "_a").alias("archive"), F.coalesce("offset", "_o").alias("offset"),
                       state.alias("state"), F.col("digest").alias("left_digest"), F.col("_d").alias("right_digest"))
