"""Plan inspection for tests and benchmarks (reads ``explain`` text only)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def has_cartesian(df: DataFrame) -> bool:
    t = plan_text(df, "simple")
    return "CartesianProduct" in t or "BroadcastNestedLoopJoin" in t


def has_unpartitioned_window(df: DataFrame) -> bool:
    """True if a Window operator runs without partition keys (one task for all rows)."""
    t = plan_text(df, "formatted")
    for block in t.split("\n\n"):
        if block.lstrip().startswith("(") and ") Window" in block.split("\n")[0]:
            if "Partition Spec: []" in block or "partitionSpec=[]" in block:
                return True
    return False


def pushed_filters(df: DataFrame) -> list[str]:
    return [ln.strip() for ln in plan_text(df, "formatted").splitlines()
            if ln.strip().startswith("PushedFilters")]


def read_schemas(df: DataFrame) -> list[str]:
    return [ln.strip() for ln in plan_text(df, "formatted").splitlines()
            if ln.strip().startswith("ReadSchema")]
