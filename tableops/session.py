"""Session helpers: a sane default session for tests and local runs, and the
checkpoint-directory rule (use the cluster's shared ``spark.checkpoint.dir``; only set
one when it is unset, as in tests)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tableops",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build or reuse a session with AQE on and the UI off.

    On a cluster, set ``spark.sql.shuffle.partitions`` high enough for the largest
    shuffle (input bytes / ~128 MB) and let AQE coalesce small shuffles to the
    advisory size and split skewed join partitions; locally pass about 2x the cores.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        # checkpoint files of DataFrames that are no longer referenced are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    defaults.update({k: str(v) for k, v in conf.items()})
    for k, v in defaults.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the reliable checkpoint directory, setting one only if none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...); it is
    read from the session and never replaced. Where it is unset, a local session gets a
    fresh scratch folder, as in tests, and a cluster an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = fallback or tempfile.mkdtemp(prefix="tableops-ckpt-",
                                                  dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
