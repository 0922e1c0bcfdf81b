"""Whole-column scalars (totals, min/max, median) attached to every row.

The reference computes e.g. ``x / x.sum()`` on an in-memory column. On Spark the
scalar is a one-row aggregate evaluated once as a scalar subquery
(``DataFrame.scalar()``): no join, no window without partition keys, and Catalyst
merges several scalars over the same input into one aggregate pass
(MergeScalarSubqueries). The size of what is shipped to executors is one row by
construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(df: DataFrame, agg: Column) -> Column:
    """A Column holding the single value ``agg`` computed over all of ``df``."""
    return df.select(agg.alias("_v")).scalar()


def with_scalars(df: DataFrame, **aggs: Column) -> DataFrame:
    """Add one column per named aggregate, each evaluated once over all of ``df``."""
    return df.withColumns({name: scalar(df, a) for name, a in aggs.items()})


def column_median(df: DataFrame, c: str | Column, approx: bool = False) -> Column:
    """Median of a column as a scalar. Exact: a distributed rank selection (no value
    buffer in one task); ``approx=True``: a bounded-size sketch."""
    from tableops.plans.quantiles import exact_quantiles
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    if approx:
        return scalar(df, F.percentile_approx(x, 0.5, 10000))
    return exact_quantiles(df, x, [0.5]).select("q0").scalar()
