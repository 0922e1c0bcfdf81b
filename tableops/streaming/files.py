"""Row-local operators (filters, calculations, text jobs, flags, validation rules)
are plain DataFrame -> DataFrame functions, so they apply unchanged to a streaming
DataFrame. This module wires a file source to a file sink with a checkpoint on the
shared checkpoint directory (exactly-once file sink, restartable after failure),
and logs each micro-batch to the audit table through ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableops.sources.audit import audit, read_audit


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_stream(df: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str,
               name: str, fmt: str = "parquet", audit_path: str | None = None,
               checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Apply ``transform`` to every micro-batch of ``df`` and append the result to
    ``sink``. With ``audit_path`` each batch also appends one audit row (operation
    ``name``, rows_after = batch size). ``once=True`` processes what is available
    and stops (availableNow trigger)."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not checkpoint and not shared:
        raise ValueError("a stream needs a checkpoint folder that outlives the session: "
                         "pass checkpoint or set spark.checkpoint.dir")
    base = checkpoint or f"{shared.rstrip('/')}/stream-{name}"
    out = transform(df)

    def logged(session: SparkSession, epoch: int) -> bool:
        """Whether an earlier try of this epoch left its audit row."""
        try:
            log = read_audit(session, audit_path)
        except AnalysisException:  # no log yet
            return False
        return not log.filter((F.col("operation") == name) & (F.col("output") == sink) & (
            F.get_json_object("params", "$.epoch").cast("long") == epoch)).isEmpty()

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # one directory per epoch, overwritten on replay: a retried batch never
        # duplicates rows
        batch.persist()
        try:
            batch.write.mode("overwrite").format(fmt).save(f"{sink.rstrip('/')}/batch_id={epoch}")
            if audit_path and not logged(batch.sparkSession, epoch):
                audit(batch.sparkSession, audit_path, operation=name, output=sink,
                      rows_after=batch.count(), params={"epoch": epoch})
        finally:
            batch.unpersist()

    w = out.writeStream.option("checkpointLocation", base).queryName(name)
    w = w.trigger(availableNow=True) if once else w
    if audit_path:
        return w.foreachBatch(write_batch).start()
    return w.format(fmt).option("path", sink).outputMode("append").start()
