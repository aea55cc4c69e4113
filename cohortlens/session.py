"""Session defaults for local runs. On a cluster the caller's own session is used unchanged."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "cohortlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("COHORTLENS_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # One machine: a temporary folder is shared by all its tasks.
        .config("spark.checkpoint.dir", os.environ.get("COHORTLENS_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) and the
    master is local is a temporary folder used; a cluster without the setting is an error, never a machine-local path.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
