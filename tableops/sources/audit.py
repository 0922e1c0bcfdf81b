"""Append-only audit table.

One row per saved operation (read-only runs are not logged, as in the reference).
Appends are ordinary ``mode('append')`` writes of a one-row DataFrame, so several
writers can log into the same shared directory without a server.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("operation", T.StringType(), False),
    T.StructField("output", T.StringType(), True),
    T.StructField("rows_before", T.LongType(), True),
    T.StructField("rows_after", T.LongType(), True),
    T.StructField("params", T.StringType(), True),
])


def audit(spark: SparkSession, path: str, operation: str, source: str | None = None,
          output: str | None = None, rows_before: int | None = None,
          rows_after: int | None = None, params: dict | None = None,
          ts: _dt.datetime | None = None) -> None:
    """Append one audit row (params stored as JSON text)."""
    row = (ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), source, operation,
           output, rows_before, rows_after,
           json.dumps(params or {}, sort_keys=True, default=str))
    spark.createDataFrame([row], AUDIT_SCHEMA).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The whole log."""
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def export_audit(spark: SparkSession, path: str, out: str) -> str:
    """Export the log as JSON lines (timestamps as ISO text)."""
    read_audit(spark, path).write.mode("errorifexists").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(out)
    return out
