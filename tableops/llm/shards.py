"""Sharding [native]: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by the digest of the text. The least shard capacity for
which a greedy left-to-right filling needs no more than ``shards`` shards is found by a
search over capacities, and the groups are cut where that filling cuts.

The groups' running sizes are spread over hash blocks and written once to the shared
checkpoint folder. A greedy step from a given place is "the last group end not beyond place
plus capacity", so a whole filling is one lookup for each shard; a job answers the lookup
for ``PROBES`` capacities at once, and every round divides the capacities left by that
number. The driver holds these few numbers and the cuts only. Rows find their shard by
comparing their digest with the cuts, without a join, and their slot from counts per
(shard, digest block, part of the row key): a group with a third of all rows is spread
over ``PARTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.common import block_offsets, pick, whole_text
from tableops.plans.lineage import cut_lineage

BLOCKS = 4096
PARTS = 64
PROBES = 16


def _block(digest: Column) -> Column:
    """The first three hex digits: BLOCKS equal slices of the digests' order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def group_ends(rows: DataFrame) -> DataFrame:
    """One row a group, in the order of digests: ``_g``, its bytes, and ``_end``, the bytes
    of all groups up to and with it."""
    groups = rows.groupBy("_g").agg(F.sum("_size").alias("_bytes")).withColumn("_block", _block(F.col("_g")))
    groups = cut_lineage(groups)
    offsets = block_offsets(groups, "_block", ["_bytes"])
    running = F.sum("_bytes").over(Window.partitionBy("_block").orderBy("_g"))
    return groups.withColumn("_run", running).join(
        F.broadcast(offsets), F.col("_block") == F.col("_b")).select(  # at most BLOCKS rows
        "_g", "_bytes", (F.col("_run") + F.col("_before__bytes")).alias("_end"))


def _fillings(ends: DataFrame, capacities: list[int], shards: int, total: int) -> list[list[int]]:
    """For each capacity the ends of the shards of a greedy filling (shorter than the whole
    if the capacity does not do). Capacities hold the largest group, so each step moves on."""
    at = [[0] for _ in capacities]
    for _ in range(shards):
        reach = [places[-1] + c for places, c in zip(at, capacities)]
        low = min(places[-1] for places in at)
        found = ends.filter((F.col("_end") > low) & (F.col("_end") <= max(reach))).agg(*[
            F.max(F.when(F.col("_end") <= r, F.col("_end"))) for r in reach]).first()
        for places, f in zip(at, found):
            places.append(max(places[-1], f or 0))
        if all(places[-1] == total for places in at):
            break
    return at


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the running size at each shard's end."""
    facts = ends.agg(F.max("_end"), F.max("_bytes")).first()
    total, largest = facts[0] or 0, facts[1] or 0
    if not total:
        return 0, []
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, (high - low) // (PROBES - 1))
        tried = sorted({min(high, low + k * step) for k in range(PROBES - 1)} | {high})
        filled = _fillings(ends, tried, shards, total)
        k = next(k for k, places in enumerate(filled) if places[-1] == total)
        best, high = filled[k], tried[k]
        low = tried[k - 1] + 1 if k else high
    return high, best[1:]


def shard_rows(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``law`` = ``bytes``, ``shard``, ``slot`` (0, 1, .. within the shard) and
    ``grown_shard`` (NULL: another shard count deals all rows anew).

    Equal texts share a shard, the NULL text counts as the empty one. The largest shard is
    as small as any contiguous cut of the digest order allows; with fewer groups than
    shards the last shards stay empty. Rows with a NULL key and repeated rows get a slot
    each. An empty table gives an empty result."""
    body = whole_text("_text")
    rows = cut_lineage(pick(df, _key=key, _text=text).select(
        "_key", (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(body).alias("_crc"), F.md5(body).alias("_g")))
    ends = cut_lineage(group_ends(rows))
    _, cuts = minimax_cuts(ends, shards)
    last = {r["_end"]: r["_g"] for r in ends.filter(F.col("_end").isin(cuts)).collect()} if cuts else {}
    borders = [last[c] for c in sorted(set(cuts))]  # the last digest of each shard, `shards` at most
    shard = F.lit(0)
    for border in borders[:-1]:
        shard = shard + (F.col("_g") > border).cast("int")
    placed = rows.withColumn("_shard", shard).withColumn(
        "_unit", F.col("_shard") * (BLOCKS * PARTS) + _block(F.col("_g")) * PARTS
        + F.pmod(F.xxhash64("_key", "_g"), F.lit(PARTS)).cast("int"))
    # a unit lies in one shard; there are BLOCKS * PARTS of them plus what the cuts split
    counts = placed.groupBy("_unit", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_unit").alias("_u"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_unit").orderBy("_g", "_key")
    return placed.withColumn("_r", F.row_number().over(within)).join(
        starts, F.col("_unit") == F.col("_u")).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_r") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
