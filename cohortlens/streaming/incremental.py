"""Mergeable metric accumulators and resumable, guarded ingestion on Structured Streaming.

Each micro-batch writes its partial counts under its batch number. A replayed batch overwrites the same folder, so the
sum over all partials counts every element exactly once, and finalizing is an ordinary batch query over a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import digests
from cohortlens.operators import confusion, sweep
from cohortlens.operators.sets import AuditError

ELEMENT_SCHEMA = T.StructType([
    T.StructField("subject", T.LongType()), T.StructField("z", T.IntegerType()), T.StructField("modality", T.StringType()),
    T.StructField("score", T.FloatType()), T.StructField("label", T.BooleanType()),
])


def partial_counts(batch: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per subject and threshold of the batch; partial rows of a subject add up."""
    return sweep.sweep_counts(batch, thresholds)


def run_sweep_stream(spark: SparkSession, source: str, state: str, thresholds: Sequence[float], files_per_batch: int = 1) -> None:
    """Consume everything available in ``source`` and stop; call again to resume after new files arrive."""
    stream = spark.readStream.schema(ELEMENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        partial_counts(batch, thresholds).write.mode("overwrite").parquet(f"{state}/partials/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def finalize_sweep(spark: SparkSession, state: str) -> DataFrame:
    """Merge the partial counts and finalize: macro Dice and micro rates per threshold."""
    partials = spark.read.parquet(f"{state}/partials")
    merged = partials.groupBy("subject", "ord", "thr").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    return confusion.macro_micro(merged, ["ord", "thr"])


def run_counts_stream(spark: SparkSession, source: str, schema: T.StructType, keys: Sequence[str], value: str, state: str, files_per_batch: int = 1) -> DataFrame:
    """Count and sum per key of everything that has arrived in ``source``; call again to resume after new files arrive.

    Every batch writes its own partial sums to ``state``, in a folder that a replay overwrites, and the partials are
    merged by a plain aggregate: no key is held by the driver.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        sums.write.mode("overwrite").parquet(f"{state}/partials/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{state}/partials").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ingest_missing(spark: SparkSession, source: str, schema: T.StructType, target: str, key: str, files_per_batch: int = 1) -> None:
    """Append only subjects that are not stored yet. A batch number owns its folder, so a replay rewrites the same rows
    and the subjects of other batches decide what is missing.

    A stored subject that arrives again has to bring exactly its stored rows, in any order: other rows, a changed value or a missing
    label stop the stream, as they would otherwise be lost.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    columns = [f.name for f in schema.fields]

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch
        stored = _stored(spark, target)
        if stored is not None:
            others = stored.where(F.col("batch") != number)
            known = others.select(key).distinct()
            again = digests.set_digest(batch.join(known, key, "left_semi"), [key], columns)
            before = digests.set_digest(others.join(batch.select(key).distinct(), key, "left_semi"), [key], columns)
            other = again.join(before, again.columns, "left_anti").select(key).take(1)
            if other:
                raise AuditError(f"{key} {other[0][0]} is stored with other rows than have arrived now")
            fresh = batch.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _stored(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def guarded_append(rows: DataFrame, target: str, fingerprint: str) -> None:
    """Append to a store that was started with the same fingerprint; refuse anything else."""
    spark = rows.sparkSession
    stored = _stored(spark, target)
    if stored is not None:
        other = stored.where(F.col("fingerprint") != fingerprint).select("fingerprint").take(1)
        if other:
            raise AuditError(f"store was built with fingerprint {other[0][0]}, not {fingerprint}")
    rows.withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").parquet(target)


def cache_status(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MISSING / STALE / INVALID / the stored status for every expected (subject, mode)."""
    have = observed.select(*keys, F.col("fingerprint").alias("_have"), F.col("readable").alias("_ok"), F.col("status").alias("_status"))
    both = expected.select(*keys, F.col("fingerprint").alias("_want")).join(have, list(keys), "left")
    status = (
        F.when(F.col("_have").isNull(), "MISSING").when(F.col("_have") != F.col("_want"), "STALE")
        .when(~F.coalesce("_ok", F.lit(False)), "INVALID").otherwise(F.coalesce("_status", F.lit("INVALID")))
    )
    return both.select(*keys, status.alias("status"))


def score_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fingerprint of the scores per subject; the threshold method is not part of it, so methods share scores."""
    return digests.set_digest(df, ["subject"], columns)
