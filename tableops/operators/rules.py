"""Conditional formats as data columns (rendering is not built).

Whole-column anchors (min, median, max) are scalar subqueries evaluated once and
merged into one aggregation pass; no join and no unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import is_numeric, not_nan, require
from tableops.plans.totals import column_median, scalar

# The three-colour scale of the reference (minimum, 50th percentile,
# maximum) and its default highlight colour.
SCALE_MIN = "F8696B"
SCALE_MID = "FFEB84"
SCALE_MAX = "63BE7B"
DEFAULT_HIGHLIGHT = "FFFF00"

_OPS = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__", "==": "__eq__",
        "!=": "__ne__"}


def _cond(df: DataFrame, c: str, op: str, value) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}")
    x = not_nan(df, c) if is_numeric(df, c) else F.col(c)
    return F.coalesce(getattr(x, _OPS[op])(F.lit(value)), F.lit(False))


def flag(df: DataFrame, c: str, op: str, value, out: str) -> DataFrame:
    """R1/R2 (highlight_negative / highlight_positive and any comparison): boolean
    column, NULL cells are false."""
    require(df, [c])
    return df.withColumn(out, _cond(df, c, op, value))


def color_when(df: DataFrame, c: str, op: str, value, out: str,
               color: str = DEFAULT_HIGHLIGHT) -> DataFrame:
    """R3 (highlight / conditional_color): ``color`` where the condition holds, else
    NULL."""
    require(df, [c])
    return df.withColumn(out, F.when(_cond(df, c, op, value), F.lit(color.upper())))


def data_bar(df: DataFrame, c: str, out: str) -> DataFrame:
    """Bar length in [0, 1] between the column minimum and maximum; a flat
    column gives 0; NULL gives NULL."""
    require(df, [c])
    x = not_nan(df, c).cast("double")
    # bind each scalar to a column once, so each subquery appears once in the plan
    d = df.withColumns({"_lo": scalar(df, F.min(x)), "_hi": scalar(df, F.max(x))})
    lo, hi = F.col("_lo"), F.col("_hi")
    return d.withColumn(out, F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(
        F.when(x.isNotNull(), F.lit(0.0)))).drop("_lo", "_hi")


def _channel(hexcolor: str, i: int) -> int:
    return int(hexcolor[2 * i:2 * i + 2], 16)


def color_scale(df: DataFrame, c: str, out: str, approx: bool = False,
                low: str = SCALE_MIN, mid: str = SCALE_MID, high: str = SCALE_MAX) -> DataFrame:
    """R5 (color_scale / heatmap): ``RRGGBB`` per cell, interpolated linearly per
    channel from ``low`` at the minimum to ``mid`` at the median (50th percentile,
    linear) to ``high`` at the maximum; channels round half up. NULL gives NULL.
    ``approx=True`` takes the median from a bounded sketch."""
    require(df, [c])
    x = not_nan(df, c).cast("double")
    # bind each scalar to a column once: a subquery holding a nondeterministic
    # expression (the rank selection) is never deduplicated by Spark, so every
    # textual reference would run it again
    d = df.withColumns({"_lo": scalar(df, F.min(x)), "_hi": scalar(df, F.max(x)),
                        "_md": column_median(df, x, approx)})
    lo, hi, md = F.col("_lo"), F.col("_hi"), F.col("_md")
    t_lo = F.when(md > lo, (x - lo) / (md - lo)).otherwise(F.lit(0.0))
    t_hi = F.when(hi > md, (x - md) / (hi - md)).otherwise(F.lit(0.0))
    chans = []
    for i in range(3):
        a, b, z = _channel(low, i), _channel(mid, i), _channel(high, i)
        v = F.when(x <= md, F.lit(a) + F.lit(b - a) * t_lo).otherwise(F.lit(b) + F.lit(z - b) * t_hi)
        chans.append(F.lpad(F.upper(F.hex(F.round(v, 0).cast("int"))), 2, "0"))
    return d.withColumn(out, F.when(x.isNotNull(), F.concat(*chans))).drop("_lo", "_hi", "_md")
