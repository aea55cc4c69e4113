"""Scored-element evaluation: normalization, sweeps, adaptive thresholds, Dice."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.functions import scalars
from cohortlens.operators import adaptive, confusion, sweep
from cohortlens.plans import tables as t

THRESHOLDS = sweep.threshold_list(0.0, 1.0, 0.001)
# The loop reads the elements once per cutoff: 141 s for a thousand of them on the smallest check, so it keeps a short list.
LOOP_THRESHOLDS = sweep.threshold_list(0.0, 1.0, 0.05)
THR_SQL, LOOP_SQL = (", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(listed)) for listed in (THRESHOLDS, LOOP_THRESHOLDS))
COUNTS_SQL = """count(*) FILTER (WHERE p AND label) AS tp, count(*) FILTER (WHERE NOT p AND NOT label) AS tn,
  count(*) FILTER (WHERE p AND NOT label) AS fp, count(*) FILTER (WHERE NOT p AND label) AS fn"""


@query("a1_confusion_counts", f"""WITH {S.TIED}, m AS (SELECT subject, label, score > 0.05::FLOAT AS p FROM tied)
SELECT subject, {COUNTS_SQL} FROM m GROUP BY subject""")
def confusion_counts(spark, d):
    return confusion.confusion(t.elements(spark, d, "l_discount"), ["subject"], scalars.above("score", 0.05))


@query("a2_rates", f"""WITH {S.TIED}, m AS (SELECT subject, label, score > 0.08::FLOAT AS p FROM tied),
c AS (SELECT subject, {COUNTS_SQL} FROM m GROUP BY subject)
SELECT subject, round(tp / greatest(tp + fn, 1), 9) AS sensitivity, round(tn / greatest(tn + fp, 1), 9) AS specificity,
       round(tp / greatest(tp + fp, 1), 9) AS precision FROM c""")
def rates(spark, d):
    counted = confusion.confusion(t.elements(spark, d, "l_discount"), ["subject"], scalars.above("score", 0.08))
    return confusion.with_rates(counted).select(
        "subject", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "precision")]
    )


@query("a3_dice_empty_zero", f"""WITH {S.TIED}, m AS (SELECT subject, z, label, score > 0.09::FLOAT AS p FROM tied),
c AS (SELECT subject, z, {COUNTS_SQL} FROM m GROUP BY subject, z)
SELECT subject, z, round(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8), 9) AS dice FROM c""")
def dice_empty_zero(spark, d):
    counted = confusion.confusion(t.elements(spark, d, "l_discount"), ["subject", "z"], scalars.above("score", 0.09))
    return counted.select("subject", "z", F.round(confusion.count_dice(0.0), 9).alias("dice"))


@query("a4_dice_empty_one", f"""WITH {S.TIED}, m AS (SELECT subject, z, modality, label, score > 0.09::FLOAT AS p FROM tied),
c AS (SELECT subject, z, modality, {COUNTS_SQL} FROM m GROUP BY subject, z, modality)
SELECT subject, z, modality, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS dice FROM c""")
def dice_empty_one(spark, d):
    keys = ["subject", "z", "modality"]
    counted = confusion.confusion(t.elements(spark, d, "l_discount"), keys, scalars.above("score", 0.09))
    return counted.select(*keys, F.round(confusion.count_dice(1.0), 9).alias("dice"))


@query("a5_macro_dice_micro_rates", f"""WITH {S.TIED},
m AS (SELECT subject, modality, label, score > 0.03::FLOAT AS p FROM tied),
c AS (SELECT modality, subject, {COUNTS_SQL} FROM m GROUP BY modality, subject)
SELECT modality, count(*) AS subjects, round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9) AS dice,
  round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS sensitivity, round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS precision
FROM c GROUP BY modality""")
def macro_dice(spark, d):
    df = t.elements(spark, d, "l_discount")
    counted = confusion.confusion(df, ["modality", "subject"], scalars.above("score", 0.03))
    return confusion.macro_micro(counted, ["modality"]).select(
        "modality", "subjects", *[F.round(c, 9).alias(c) for c in ("dice", "sensitivity", "precision")]
    )


SWEEP_SQL = f"""thr(ord, thr) AS (VALUES {THR_SQL}),
x AS (SELECT ord, thr, subject, label, score > CAST(thr AS FLOAT) AS p FROM normalized, thr),
c AS (SELECT ord, thr, subject, {COUNTS_SQL} FROM x GROUP BY ord, thr, subject)"""
SWEEP_ROW_SQL = """SELECT ord, thr, count(*) AS subjects, round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9) AS dice,
  round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS sensitivity, round(sum(tn) / greatest(sum(tn) + sum(fp), 1), 9) AS specificity,
  round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS precision FROM c GROUP BY ord, thr"""


@query("a6_threshold_list", f"""WITH {S.TIED}, thr(ord, thr) AS (VALUES {THR_SQL}),
n AS (SELECT round(CAST(score AS DOUBLE), 2) AS s, count(*) AS n FROM tied GROUP BY 1)
SELECT ord, thr, CAST(coalesce(sum(n), 0) AS BIGINT) AS elements_above FROM thr LEFT JOIN n ON s > thr GROUP BY ord, thr""")
def threshold_list(spark, d):
    # Elements above each listed threshold, by a suffix sum over the buckets of the whole table.
    df = t.elements(spark, d, "l_discount").withColumn("subject", F.lit(0)).withColumn("label", F.lit(True))
    df = df.withColumn("score", F.round(F.col("score").cast("double"), 2).cast("float"))
    return sweep.sweep_counts(df, THRESHOLDS).select("ord", "thr", F.col("tp").alias("elements_above"))


@query("a7_threshold_sweep_loop", f"WITH {S.NORMALIZED}, {SWEEP_SQL.replace(THR_SQL, LOOP_SQL)} {SWEEP_ROW_SQL}")
def sweep_loop(spark, d):
    df = adaptive.normalize_minmax(t.elements(spark, d))
    return rounded_sweep(confusion.macro_micro(sweep.sweep_counts_loop(df, LOOP_THRESHOLDS), ["ord", "thr"]))


def rounded_sweep(df):
    cols = ("dice", "sensitivity", "specificity", "precision")
    return df.select("ord", "thr", "subjects", *[F.round(c, 9).alias(c) for c in cols])


@query("a8_threshold_sweep", f"WITH {S.NORMALIZED}, {SWEEP_SQL} {SWEEP_ROW_SQL}")
def sweep_bucket(spark, d):
    return rounded_sweep(sweep.sweep_metrics(adaptive.normalize_minmax(t.elements(spark, d)), THRESHOLDS))


@query("e4_suffix_sums", f"WITH {S.NORMALIZED}, {SWEEP_SQL} SELECT subject, ord, thr, tp, tn, fp, fn FROM c")
def suffix_sums(spark, d):
    return sweep.sweep_counts(adaptive.normalize_minmax(t.elements(spark, d)), THRESHOLDS)


@query("a17_best_dice_threshold", f"""WITH {S.NORMALIZED}, {SWEEP_SQL}, r AS ({SWEEP_ROW_SQL})
SELECT thr AS best_thr, dice AS best_dice FROM r ORDER BY dice DESC, ord LIMIT 1""")
def best_dice(spark, d):
    rows = rounded_sweep(sweep.sweep_metrics(adaptive.normalize_minmax(t.elements(spark, d)), THRESHOLDS))
    return confusion.best_threshold(rows, [])


ADAPTIVE_SQL = """h AS (SELECT e.subject, lo, hi, CASE WHEN hi = lo THEN 0 ELSE
    CAST(least(255, floor((CAST(score AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo) * 256)) AS INTEGER) END AS bin, count(*) AS c
  FROM normalized e JOIN (SELECT subject, CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi FROM normalized GROUP BY subject) b
    USING (subject) GROUP BY ALL),
w AS (SELECT subject, lo, hi, bin, CAST(sum(c) OVER u AS DOUBLE) AS w0, CAST(sum(c * bin) OVER u AS DOUBLE) AS s0, CAST(sum(c * c) OVER u AS DOUBLE) AS q0,
    CAST(sum(c) OVER a AS DOUBLE) AS w, CAST(sum(c * bin) OVER a AS DOUBLE) AS s, CAST(sum(c * c) OVER a AS DOUBLE) AS q
  FROM h WINDOW u AS (PARTITION BY subject ORDER BY bin), a AS (PARTITION BY subject)),
k AS (SELECT *, {crit} AS crit FROM w WHERE w > w0),
b AS (SELECT subject, lo, hi, bin FROM k QUALIFY row_number() OVER (PARTITION BY subject ORDER BY crit DESC, bin) = 1),
thresholds AS (SELECT s.subject, CAST(coalesce(b.lo + (b.bin + 0.5::DOUBLE) * (b.hi - b.lo) / 256, s.lo) AS FLOAT) AS thr
  FROM (SELECT DISTINCT subject, lo FROM h) s LEFT JOIN b USING (subject))"""
CRITERIA = {
    "otsu": "w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2)",
    "yen": "pow((w0 / w) * (1.0 - w0 / w), 2) / (q0 * (q - q0))",
}


def adaptive_sql(method):
    return ADAPTIVE_SQL.replace("{crit}", CRITERIA[method])


def _thresholds(method):
    @query(f"i10_{method}_threshold", f"""WITH {S.NORMALIZED}, {adaptive_sql(method)}
SELECT subject, round(CAST(thr AS DOUBLE), 7) AS thr FROM thresholds""")
    def run(spark, d):
        df = adaptive.normalize_minmax(t.elements(spark, d))
        out = adaptive.adaptive_thresholds(df, method)
        return out.select("subject", F.round(F.col("thr").cast("double"), 7).alias("thr"))

    @query(f"a18_{method}_summary", f"""WITH {S.NORMALIZED}, {adaptive_sql(method)},
m AS (SELECT n.subject, label, score > thr AS p, thr FROM normalized n JOIN thresholds USING (subject)),
c AS (SELECT subject, thr, {COUNTS_SQL} FROM m GROUP BY subject, thr)
SELECT round(avg(CAST(thr AS DOUBLE)), 7) AS threshold, round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9) AS dice,
 round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS sensitivity, round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS precision FROM c""")
    def summary(spark, d):
        df = adaptive.normalize_minmax(t.elements(spark, d))
        out = adaptive.adaptive_summary(adaptive.adaptive_counts(df, adaptive.adaptive_thresholds(df, method)))
        return out.select(
            F.round("threshold", 7).alias("threshold"),
            *[F.round(c, 9).alias(c) for c in ("dice", "sensitivity", "precision")],
        )

    return run, summary


for _method in ("otsu", "yen"):
    _thresholds(_method)


@query("a19_unlabelled_gate", f"""WITH {S.TIED}, m AS (SELECT subject, modality, z, CASE WHEN subject % 7 = 0 AND z IN (2, 5) THEN NULL ELSE label END AS label, score > 0.05::FLOAT AS p FROM tied),
gate AS (SELECT z, bool_and(label IS NOT NULL) AS ok FROM m GROUP BY z),
c AS (SELECT z, subject, {COUNTS_SQL} FROM m GROUP BY z, subject),
r AS (SELECT z, count(*) AS subjects, avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)) AS dice, (SELECT count(*) FROM m WHERE p AND m.z = c.z) AS predicted FROM c GROUP BY z)
SELECT z, subjects, CAST(predicted AS BIGINT) AS predicted, CASE WHEN ok THEN round(dice, 9) END AS dice FROM r JOIN gate USING (z)""")
def unlabelled_gate(spark, d):
    # Some subjects have no labels in two z levels: label metrics are NULL there, the count of predictions stays.
    df = t.elements(spark, d, "l_discount").withColumn("label", F.when(~((F.col("subject") % 7 == 0) & F.col("z").isin(2, 5)), F.col("label")))
    hit = scalars.above("score", 0.05)
    gate = df.groupBy("z").agg(F.bool_and(F.col("label").isNotNull()).alias("ok"), F.count_if(hit).alias("predicted"))
    rows = confusion.macro_micro(confusion.confusion(df, ["z", "subject"], hit), ["z"]).join(gate, "z")
    gated = confusion.gated_by_labels(rows, F.col("ok"), ["dice"])
    return gated.select("z", "subjects", "predicted", F.round("dice", 9).alias("dice"))


@query("a20_model_summary", f"""WITH {S.TIED}, m AS (SELECT modality AS model, subject, label, score > 0.06::FLOAT AS p FROM tied),
c AS (SELECT model, subject, {COUNTS_SQL} FROM m GROUP BY model, subject),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, 2.0 * tp / greatest(2 * tp + fp + fn, 1e-8) AS d FROM c)
SELECT model, count(*) AS cases, round(avg(p), 9) AS mean_precision, round(avg(r), 9) AS mean_recall, round(avg(d), 9) AS mean_dice,
 round(median(p), 9) AS median_precision, round(median(r), 9) AS median_recall, round(median(d), 9) AS median_dice,
 CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
 round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS pooled_precision, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS pooled_recall
FROM r GROUP BY model""")
def model_summary(spark, d):
    df = t.elements(spark, d, "l_discount").withColumnRenamed("modality", "model")
    out = confusion.model_summary(confusion.confusion(df, ["model", "subject"], scalars.above("score", 0.06)), "model")
    return out.select(
        "model", "cases", "tp", "fp", "fn",
        *[F.round(c, 9).alias(c) for c in out.columns if c.startswith(("mean_", "median_", "pooled_"))],
    )


@query("i6_minmax_subject", f"""WITH {S.NORMALIZED}
SELECT subject, z, modality, label, count(*) AS n, round(sum(CAST(score AS DOUBLE)), 6) AS total, CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi
FROM normalized GROUP BY ALL""")
def minmax_subject(spark, d):
    return score_profile(adaptive.normalize_minmax(t.elements(spark, d), "subject"))


def score_profile(df):
    s = F.col("score").cast("double")
    return df.groupBy("subject", "z", "modality", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(s), 6).alias("total"), F.min(s).alias("lo"), F.max(s).alias("hi")
    )


@query("i7_minmax_dataset", f"""WITH {S.ELEMENTS}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM elements),
normalized AS (SELECT subject, z, modality, label, CAST(CAST(CAST(score AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT)::DOUBLE
  / greatest(CAST(CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT), 1e-8::FLOAT)::DOUBLE AS FLOAT) AS score FROM elements, b)
SELECT subject, z, modality, label, count(*) AS n, round(sum(CAST(score AS DOUBLE)), 6) AS total, CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi
FROM normalized GROUP BY ALL""")
def minmax_dataset(spark, d):
    return score_profile(adaptive.normalize_minmax(t.elements(spark, d), "dataset"))


@query("j15_mask_overlap", """WITH a AS (SELECT DISTINCT l_suppkey AS subject, l_orderkey AS o, l_linenumber AS z FROM lineitem WHERE CAST(l_discount AS FLOAT) > 0.04::FLOAT),
b AS (SELECT DISTINCT l_suppkey AS subject, l_orderkey AS o, l_linenumber AS z FROM lineitem WHERE CAST(l_tax AS FLOAT) > 0.02::FLOAT),
j AS (SELECT coalesce(a.subject, b.subject) AS subject, a.o IS NOT NULL AS ia, b.o IS NOT NULL AS ib
      FROM a FULL JOIN b ON a.subject = b.subject AND a.o = b.o AND a.z = b.z),
c AS (SELECT subject, count(*) FILTER (WHERE ia AND ib) AS intersection, count(*) AS "union", count(*) FILTER (WHERE NOT ib) AS a_only,
      count(*) FILTER (WHERE NOT ia) AS b_only FROM j GROUP BY subject)
SELECT *, round(2.0 * intersection / (2 * intersection + a_only + b_only), 9) AS dice, round(intersection / "union", 9) AS jaccard FROM c""")
def mask_overlap(spark, d):
    lines = t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("z"),
        "l_discount", "l_tax",
    )
    a = lines.where(scalars.above("l_discount", 0.04)).select("subject", "o", "z").distinct()
    b = lines.where(scalars.above("l_tax", 0.02)).select("subject", "o", "z").distinct()
    out = confusion.mask_overlap(a, b, ["subject"], ["o", "z"])
    return out.withColumns({c: F.round(c, 9) for c in ("dice", "jaccard")})


@query("flagship_evaluation", f"""WITH {S.NORMALIZED}, {adaptive_sql('otsu')}, {SWEEP_SQL}, r AS ({SWEEP_ROW_SQL}),
m AS (SELECT n.subject, label, score > t.thr AS p, t.thr FROM normalized n JOIN thresholds t USING (subject)),
a AS (SELECT subject, thr, {COUNTS_SQL} FROM m GROUP BY subject, thr)
SELECT 'sweep' AS metric, thr, dice, sensitivity, precision FROM r UNION ALL
SELECT 'otsu', round(avg(CAST(thr AS DOUBLE)), 7), round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9),
 round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9), round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) FROM a""")
def flagship(spark, d):
    from cohortlens.plans.evaluation import evaluate_elements

    return evaluate_elements(t.elements(spark, d), THRESHOLDS, method="otsu")
