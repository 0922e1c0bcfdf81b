"""Sorting, top-k and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, not_nan, require, total_order


def sort_rows(df: DataFrame, cols: str | Sequence[str], desc: bool = False) -> DataFrame:
    """O1/O2: sort on ``cols``, NULLs and NaN last in both directions (range exchange plus a
    spillable external sort)."""
    cols = as_list(cols)
    require(df, [c for c in cols if isinstance(c, str)])
    key = [(not_nan(df, c).desc_nulls_last() if desc else not_nan(df, c).asc_nulls_last())
           if isinstance(c, str) else c for c in cols]
    return df.orderBy(*key)


def top_k(df: DataFrame, by: str | Sequence[str], k: int, desc: bool = True,
          tie_break: Sequence[str | Column] | None = None) -> DataFrame:
    """O3: the ``k`` rows with the largest (or smallest) ``by``. Ties are broken by
    ``tie_break`` then all other columns, so the result is deterministic. Planned as
    TakeOrderedAndProject: per-task top ``k``, merged on the driver (``k`` x tasks)."""
    by = as_list(by)
    require(df, by)
    key = [not_nan(df, c).desc_nulls_last() if desc else not_nan(df, c).asc_nulls_last() for c in by]
    key += total_order(df, tie_break, exclude=by)
    return df.orderBy(*key).limit(k)


def deduplicate(df: DataFrame, keys: str | Sequence[str] | None = None,
                order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Keep the first row per key in ``order_by`` order (ties broken by all other
    columns); NULL keys form one group, as in pandas.

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    exchange, so each task ships at most one row per key: a key holding a third of
    the table costs one row per task in the shuffle, not a third of the data.
    Without ``order_by`` (and only then) any row of a group may be kept:
    ``dropDuplicates`` with partial aggregation."""
    keys = as_list(keys) or list(df.columns)
    require(df, keys)
    if order_by is None:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*total_order(df, order_by, exclude=keys))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
