"""G3 on a stream: event-time windowed series with a watermark.

The batch line series truncates timestamps to a bucket and aggregates. On a stream
the same numbers come from ``window()`` groups: the watermark bounds how late a row
may arrive and still update its window, and lets Spark drop window state once it
is final, so state stays bounded by (open windows x keys), not by the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, require
from tableops.operators.aggregate import agg_expr, check_fn

_STREAMABLE = ("sum", "mean", "count", "min", "max", "std")


def windowed_series(stream: DataFrame, ts: str, values: str | Sequence[str], window: str = "1 day",
                    watermark: str = "1 hour", fn: str = "sum",
                    keys: Sequence[str] | None = None) -> DataFrame:
    """Per event-time ``window`` (and ``keys``): ``fn`` of each value column, with
    the window start as ``ts``. Exact medians need the whole group and are not
    offered on streams."""
    values, keys = as_list(values), as_list(keys)
    require(stream, [ts] + values + keys)
    if check_fn(fn) not in _STREAMABLE:
        raise ValueError(f"{fn!r} is not available on a stream; use one of {_STREAMABLE}")
    from pyspark.sql import types as T
    ntz = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    # watermarks need TIMESTAMP; wall-clock NTZ values are read in the session time
    # zone (UTC in get_spark), so day windows line up with the batch buckets
    base = stream.filter(F.col(ts).isNotNull()).withColumn("_et", F.col(ts).cast("timestamp"))
    g = (base.withWatermark("_et", watermark)
         .groupBy(F.window("_et", window).alias("_w"), *keys)
         .agg(*[agg_expr(stream, v, fn).alias(v) for v in values]))
    start = F.col("_w.start").cast("timestamp_ntz") if ntz else F.col("_w.start")
    return g.select(start.alias(ts), *keys, *values)
