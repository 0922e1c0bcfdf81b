"""Exact quantiles without a hot task, one way for groups of every size.

1. One aggregation gives each group's size and, by a bounded sketch, split points among its
   values.
2. Equal values are counted (combined before the shuffle) and placed in the block between
   two split points. The block follows from the row and its group's points alone, so that
   every re-execution of either branch agrees, whether or not Spark reuses an exchange.
3. Block counts tell which blocks hold a wanted rank; only those are sorted, a block a task,
   and the values at ``floor`` and ``ceil`` of ``q * (n - 1)`` are interpolated as Spark's
   ``percentile`` and pandas' ``quantile`` do.

A group's values are spread over BLOCKS blocks of about equal size; whatever the sketch's
error, the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, null_safe_eq

BLOCKS = 64


def exact_quantiles(df: DataFrame, value: str | Column, qs: Sequence[float],
                    by: Sequence[str] | None = None, prefix: str = "q") -> DataFrame:
    """Per group of ``by`` (or overall): columns ``<prefix>0..`` = exact linear quantiles of the
    values at fractions ``qs``, NULL and NaN left out. Groups without values are absent."""
    by = as_list(by)
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    # overall: one group, whose key is no constant, so that joins and windows keep a key
    named = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.pmod(F.xxhash64(x), F.lit(1)).alias("_k0")]
    base = df.select(*named, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))

    def same(names: Sequence[str], suffix: str) -> Column:
        return null_safe_eq([F.col(n) for n in names], [F.col(n + suffix) for n in names])

    points = F.percentile_approx("_x", F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)]), 1000)
    facts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(points).alias("_points")) \
        .withColumnsRenamed({k: k + "f" for k in keys})
    if not by:
        facts = F.broadcast(facts)  # one row
    placed = base.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")).join(facts, same(keys, "f")) \
        .withColumn("_b", F.size(F.filter("_points", lambda p: p < F.col("_x")))).select(*keys, "_x", "_c", "_n", "_b")
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))
    blocks = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n")) \
        .withColumn("_off", F.coalesce(F.sum("_c").over(order), F.lit(0))) \
        .filter(F.exists(ranks, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c")))) \
        .select(*[F.col(k).alias(k + "h") for k in (*keys, "_b")], "_off")
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = placed.join(blocks, same((*keys, "_b"), "h")) \
        .withColumn("_end", F.col("_off") + F.sum("_c").over(inside))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_x")))

    found = sorted_.groupBy(*keys).agg(*[a for i, p in enumerate(at) for a in (
        value_at(F.floor(p)).alias(f"_lo{i}"), value_at(F.ceil(p)).alias(f"_hi{i}"), F.max(p).alias(f"_p{i}"))])
    outs = []
    for i in range(len(qs)):
        lo, hi, p = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_p{i}")
        outs.append(F.when(F.ceil(p) == F.floor(p), lo).otherwise(
            (F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(f"{prefix}{i}"))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *outs)
