"""Row-change metrics of an operation (rows before, after, affected)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def row_counts(before: DataFrame, after: DataFrame) -> dict:
    """Rows before and after an operation and the difference (two count jobs; use
    ``observed_counts`` to get the after-count for free while writing)."""
    b, a = before.count(), after.count()
    return {"rows_before": b, "rows_after": a, "rows_affected": abs(a - b)}


def observed_counts(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row-count observation: the count is collected as a side effect of
    whatever action runs on the returned DataFrame (e.g. the write), no extra pass.
    Read it with ``obs.get['rows']`` after the action."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
