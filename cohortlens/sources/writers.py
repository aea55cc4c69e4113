"""Sinks: partitioned products, staged publication, fixed-order tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, *columns: str, path: str | None = None, mode: str = "errorifexists") -> str:
    target = path or scratch(df.sparkSession, "partitioned")
    df.write.mode(mode).partitionBy(*columns).parquet(target)
    return target


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def publish(df: DataFrame, target: str, audit, partition_by: Sequence[str] = ()) -> str:
    """Write to a staging path, audit what was written, then rename it into place.

    ``audit`` receives the table read back and raises to refuse it. A target that exists and is not empty is refused, so
    a reader never sees a half-written or unaudited data set.
    """
    spark = df.sparkSession
    fs, final = _filesystem(spark, target)
    if fs.exists(final) and fs.listStatus(final):
        raise FileExistsError(f"refusing to replace a non-empty data set: {target}")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staging)
    try:
        audit(spark.read.parquet(staging))
    except Exception:
        fs.delete(_filesystem(spark, staging)[1], True)
        raise
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(_filesystem(spark, staging)[1], final):
        raise OSError(f"could not publish {target}")
    return target


def metric_rows(metrics: DataFrame) -> DataFrame:
    """The five-column metric table from long metrics (metric, thr, value): threshold rows first, by threshold."""
    wide = metrics.groupBy("key", "thr").pivot("metric", ["value", "dice", "sensitivity", "precision"]).agg(F.first("v"))
    return wide.orderBy(F.col("thr").isNull(), "thr", "key").select(
        F.coalesce(F.col("thr").cast("string"), F.col("key")).alias("thr"), "value", "dice", "sensitivity", "precision"
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path
