"""Chart-ready data (drawing is not built). Every series is aggregated on
the executors; only bounded results (one row per category / bucket, or a fixed
sample size) come out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, not_nan, require
from tableops.operators.aggregate import aggregate
from tableops.plans.totals import scalar


def chart_series(df: DataFrame, category: str, values: str | Sequence[str],
                 fn: str = "mean") -> DataFrame:
    """G1 (bar chart data): ``category, series, value`` with ``fn`` of each value
    column per category (average by default); NULL categories dropped."""
    values = as_list(values)
    require(df, [category] + values)
    g = aggregate(df.filter(not_nan(df, category).isNotNull()), [category], [(v, fn, v) for v in values])
    g = g.select(category, *[F.col(v).cast("double").alias(v) for v in values])
    return g.unpivot(category, values, "series", "value")


def pie_shares(df: DataFrame, category: str, value: str | None = None,
               out: str = "share", digits: int = 1) -> DataFrame:
    """G2 (pie chart data): per category the total of ``value`` (or the row count)
    and its share of the grand total in percent, rounded to ``digits``."""
    require(df, [category] + as_list(value))
    base = df.filter(not_nan(df, category).isNotNull())
    amount = F.coalesce(F.sum(not_nan(df, value)), F.lit(0)) if value else F.count(F.lit(1))
    g = base.groupBy(category).agg(amount.cast("double").alias("amount"))
    total = scalar(base, (F.sum(not_nan(df, value)) if value else F.count(F.lit(1))).cast("double"))
    return g.withColumn(out, F.round(F.try_divide(F.col("amount"), total) * 100, digits))


def line_series(df: DataFrame, x: str, values: str | Sequence[str], bucket: str | None = None,
                fn: str = "sum") -> DataFrame:
    """G3 (line chart data): one point per ``x`` (truncated to ``bucket`` such as
    ``day``, ``hour`` or ``month`` when given) with ``fn`` of each value column,
    ordered along ``x``."""
    values = as_list(values)
    require(df, [x] + values)
    base = df.filter(F.col(x).isNotNull())
    if bucket:
        base = base.withColumn(x, F.date_trunc(bucket, F.col(x)))
    return aggregate(base, [x], [(v, fn, v) for v in values]).orderBy(x)


def scatter_points(df: DataFrame, x: str, y: str, n: int = 1000, seed: int = 0,
                   key: Sequence[str] | None = None) -> DataFrame:
    """G4 (scatter data): a deterministic sample of ``n`` (x, y) points: the rows with
    the smallest MD5 of seed and key as text (key defaults to all columns). Top-n per
    task, merged on the driver: at most ``n`` rows per task move."""
    require(df, [x, y])
    k = as_list(key) or df.columns
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in k]))
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            .withColumn("_h", h).orderBy("_h", *[F.col(c).asc_nulls_last() for c in k])
            .limit(n).select(x, y))


def kpi(df: DataFrame, metrics: Mapping[str, tuple[str, str]]) -> DataFrame:
    """G5 (kpi_dashboard): ``metric, value`` rows, every metric from ONE aggregation."""
    require(df, [c for c, _ in metrics.values()])
    one = aggregate(df, [], [(c, fn, f"m{i}") for i, (c, fn) in enumerate(metrics.values())])
    one = one.select(*[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(len(metrics))])
    arr = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value"))
                    for i, name in enumerate(metrics)])
    return one.select(F.inline(arr))


def sparkline(df: DataFrame, key: str, x: str, y: str, bucket: str = "day",
              fn: str = "sum", out: str = "series") -> DataFrame:
    """G6 (sparklines): per key the ``fn(y)`` of each ``bucket`` of ``x``, as an array
    ordered along ``x``, plus the bucket array ``<out>_x``.

    Rows are first aggregated per (key, bucket) with partial aggregation, so each
    array holds one point per bucket (bounded by the time span / bucket), never the
    rows of a hot key."""
    require(df, [key, x, y])
    base = (df.filter(F.col(key).isNotNull() & F.col(x).isNotNull())
            .withColumn("_x", F.date_trunc(bucket, F.col(x))))
    pts = aggregate(base, [key, "_x"], [(y, fn, "_y")]).withColumn("_y", F.col("_y").cast("double"))
    arr = F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))))
    return (pts.groupBy(key).agg(arr.alias("_p"))
            .select(key, F.transform("_p", lambda p: p["x"]).alias(f"{out}_x"),
                    F.transform("_p", lambda p: p["y"]).alias(out)))
