"""Session settings the operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits hot partitions of sort-merge joins, and broadcasts a side once its real size is known
# to be under spark.sql.autoBroadcastJoinThreshold.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a running session and let its Python workers find this package."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    workers_find_package(spark)
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``; the extra path does no harm there.
    """
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``, else one in the warehouse, shared too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(named or f"{warehouse.rstrip('/')}/furrow-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
