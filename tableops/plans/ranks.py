"""Distributed ranks: the 0-based position of every row inside its group in a sort
order, without a window over the data.

1. range-partition and sort on ``(group keys, order)``: a hot group's rows are split
   over many partitions;
2. per (partition, group): row count and the first ``monotonically_increasing_id``
   (whose high bits are the partition index);
3. a window per group over those few rows gives each partition's rank offset and the
   group size ``_n`` (the ungrouped case is one group whose window spans one row per
   partition, bounded by the partition count, not by the data);
4. rank = offset + position inside the partition.

The sorted input is written to the shared checkpoint folder before both branches read it:
range bounds come from a sample, and a branch that sorted anew could draw others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, null_safe_eq
from tableops.plans.lineage import cut_lineage


def ranked(df: DataFrame, order_by: Sequence[Column], by: Sequence[str] | None = None,
           partitions: int | None = None, rank: str = "_r", size: str = "_n") -> DataFrame:
    """``df`` plus ``rank`` (0-based position in ``order_by`` within each ``by`` group)
    and ``size`` (rows in the group). ``order_by`` are sort Columns (asc/desc, nulls
    first/last as given)."""
    by = as_list(by)
    keys = by or ["_g"]
    base = df if by else df.withColumn("_g", F.lit(0))
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort_key = [F.col(k).asc_nulls_first() for k in keys] + list(order_by)
    srt = cut_lineage(base.repartitionByRange(n_parts, *sort_key).sortWithinPartitions(*sort_key)
                      .withColumn("_mid", F.monotonically_increasing_id()))
    per_part = (srt.groupBy(F.shiftright("_mid", 33).alias("_pid"), *keys)
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0")))
    w = Window.partitionBy(*keys).orderBy("_pid")
    per_part = (per_part
                .withColumn("_off", F.coalesce(F.sum("_c").over(
                    w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .withColumn("_tot", F.sum("_c").over(Window.partitionBy(*keys)))
                .select(F.col("_pid").alias("_pp"),
                        *[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)],
                        "_off", "_m0", "_tot"))
    s = srt.withColumn("_pid", F.shiftright("_mid", 33))
    cond = null_safe_eq([F.col("_pid")] + [F.col(k) for k in keys],
                        [F.col("_pp")] + [F.col(f"_pk{i}") for i in range(len(keys))])
    # Ungrouped, the offsets table has one row per partition: a proven bound, so it
    # is broadcast. Grouped, it has up to (partitions + groups) rows; AQE broadcasts
    # it only when its measured size is below the threshold.
    out = s.join(F.broadcast(per_part) if not by else per_part, cond).withColumns({
        rank: F.col("_off") + F.col("_mid") - F.col("_m0"), size: F.col("_tot")})
    drop = ["_mid", "_pid", "_pp", "_off", "_m0", "_tot"] + [f"_pk{i}" for i in range(len(keys))]
    if not by:
        drop.append("_g")
    return out.drop(*drop)
