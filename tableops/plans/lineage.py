"""Lineage cuts that survive executor loss.

``localCheckpoint`` and machine-local temp folders lose data with an executor; a
reliable ``checkpoint()`` writes to the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tableops.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint directory and return the reloaded
    DataFrame. Partition layout and row order inside partitions are frozen, which the
    row-index operator relies on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
