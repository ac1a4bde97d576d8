"""Spark session setup shared by tests, bench and the driver entry points.

Cluster settings always win: every option below is applied only when the
session does not already carry a value, so a cluster's own
``spark.sql.shuffle.partitions`` or ``spark.checkpoint.dir`` is never
overridden.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we rely on for correctness (UTC, ANSI-off arithmetic) or for the
# plans we want (AQE with skew-join splitting and partition coalescing).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "wardwise", partitions: int = 8) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with their frames
    builder = builder.config("spark.driver.memory", os.environ.get("WARDWISE_DRIVER_MEMORY", "8g"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where unset and make sure a checkpoint folder exists.

    ``spark.checkpoint.dir`` names the shared folder on a cluster; only a local
    session without it gets one here (local runs, tests).
    """
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    A local one is made only where it is unset and the master is local; a
    cluster must name a folder that all its machines share. The setting itself
    cannot change at run time, so a folder made here is kept by the context.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="wardwise-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
