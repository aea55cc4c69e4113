"""Streaming metrics, resume, guards, cache status."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.catalog.evaluation import CRITERIA, adaptive_sql
from cohortlens.operators import adaptive, sweep
from cohortlens.plans import tables as t
from cohortlens.sources import writers
from cohortlens.streaming import incremental

THRESHOLDS = sweep.threshold_list(0.0, 0.1, 0.02)
THR_SQL = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(THRESHOLDS))


#: Rows of one arriving file: the task that writes it reads no more, however large the table is.
FILE_ROWS = 1 << 20


def arrive(rows, key, batches, path):
    """Append ``rows`` to the folder in files of about ``FILE_ROWS``, a key in one file; the number of files in each of ``batches``."""
    each = max(1, math.ceil(rows.count() / (batches * FILE_ROWS)))
    rows.repartition(batches * each, key).write.mode("append").parquet(path)
    return each


def element_files(spark, d):
    """The scored elements written in files that arrive in four micro-batches, and the number of files in each."""
    path = writers.scratch(spark, "elements")
    return path, arrive(t.elements(spark, d, "l_discount"), "subject", 4, path)


@query("t1_streaming_sweep", f"""WITH {S.TIED}, thr(ord, thr) AS (VALUES {THR_SQL}), x AS (SELECT ord, thr, subject, label, score > CAST(thr AS FLOAT) AS p FROM tied, thr),
c AS (SELECT ord, thr, subject, count(*) FILTER (WHERE p AND label) AS tp, count(*) FILTER (WHERE p AND NOT label) AS fp, count(*) FILTER (WHERE NOT p AND label) AS fn FROM x GROUP BY ALL)
SELECT ord, thr, count(*) AS subjects, round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9) AS dice, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS sensitivity, round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS precision FROM c GROUP BY ord, thr""")
def streaming_sweep(spark, d):
    state = writers.scratch(spark, "sweep-state")
    source, each = element_files(spark, d)
    incremental.run_sweep_stream(spark, source, state, THRESHOLDS, each)
    rows = incremental.finalize_sweep(spark, state)
    return rows.select("ord", "thr", "subjects", *[F.round(c, 9).alias(c) for c in ("dice", "sensitivity", "precision")])


@query("t1_streaming_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streaming_counts(spark, d):
    events = t.table(spark, d, "events").select("event_id", "event_type", "value")
    path = writers.scratch(spark, "events")
    each = arrive(events, "event_id", 4, path)
    out = incremental.run_counts_stream(spark, path, events.schema, ["event_type"], "value", writers.scratch(spark, "counts"), each)
    return out.select("event_type", "n", F.round("total", 4).alias("total"))


@query("t2_resume_missing_subjects", "SELECT l_suppkey AS subject, count(*) AS n FROM lineitem GROUP BY 1")
def resume_missing(spark, d):
    # Every subject arrives twice; the second copy is recognised as stored.
    source, each = element_files(spark, d)
    target = writers.scratch(spark, "ingested")
    incremental.ingest_missing(spark, source, incremental.ELEMENT_SCHEMA, target, "subject", each)
    each = arrive(t.elements(spark, d, "l_discount"), "subject", 2, source)
    incremental.ingest_missing(spark, source, incremental.ELEMENT_SCHEMA, target, "subject", each)
    return spark.read.parquet(target).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("t3_fingerprint_guard", "SELECT 'refused' AS second_append, count(*) AS rows FROM lineitem")
def fingerprint_guard(spark, d):
    from cohortlens.operators.sets import AuditError

    target = writers.scratch(spark, "guarded")
    rows = t.elements(spark, d)
    incremental.guarded_append(rows, target, "score-a")
    try:
        incremental.guarded_append(rows, target, "score-b")
        outcome = "accepted"
    except AuditError:
        outcome = "refused"
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(outcome).alias("second_append"), "rows")


@query("t4_cache_status", """WITH e AS (SELECT c_custkey AS subject, m AS mode FROM customer, (VALUES ('raw'), ('mf')) v(m))
SELECT subject, mode, CASE WHEN subject % 7 = 0 THEN 'MISSING' WHEN subject % 5 = 0 THEN 'STALE' WHEN subject % 3 = 0 THEN 'INVALID' ELSE 'PASS' END AS status FROM e""")
def cache_status(spark, d):
    k = F.col("subject")
    everyone = t.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.explode(F.array(F.lit("raw"), F.lit("mf"))).alias("mode"))
    expected = everyone.withColumn("fingerprint", F.md5(F.concat_ws("|", "subject", "mode")))
    observed = expected.where(k % 7 != 0).select(
        "subject", "mode", F.when(k % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), (k % 3 != 0).alias("readable"), F.lit("PASS").alias("status"))
    return incremental.cache_status(expected, observed, ["subject", "mode"])


T5_SQL = f"""WITH {S.NORMALIZED}, {adaptive_sql('otsu')}, {adaptive_sql('yen').replace('h AS', 'h2 AS').replace('FROM h ', 'FROM h2 ').replace('FROM h)', 'FROM h2)').replace('w AS (SELECT subject, lo', 'w2 AS (SELECT subject, lo').replace('FROM w WHERE', 'FROM w2 WHERE')
    .replace('k AS (SELECT *', 'k2 AS (SELECT *').replace('FROM k QUALIFY', 'FROM k2 QUALIFY').replace('b AS (SELECT subject, lo, hi, bin FROM', 'b2 AS (SELECT subject, lo, hi, bin FROM').replace('LEFT JOIN b USING', 'LEFT JOIN b2 b USING').replace('thresholds AS', 'thresholds2 AS')}
SELECT o.subject, round(CAST(o.thr AS DOUBLE), 7) AS otsu, round(CAST(y.thr AS DOUBLE), 7) AS yen FROM thresholds o JOIN thresholds2 y USING (subject)"""
assert set(CRITERIA) == {"otsu", "yen"}


@query("t5_method_change_reuses_scores", T5_SQL)
def method_change(spark, d):
    # Scores are stored once; both methods read the stored table.
    path = writers.scratch(spark, "scores")
    adaptive.normalize_minmax(t.elements(spark, d)).write.parquet(path)
    stored = spark.read.parquet(path)
    otsu = adaptive.adaptive_thresholds(stored, "otsu").select("subject", F.round(F.col("thr").cast("double"), 7).alias("otsu"))
    return otsu.join(adaptive.adaptive_thresholds(stored, "yen").select("subject", F.round(F.col("thr").cast("double"), 7).alias("yen")), "subject")
