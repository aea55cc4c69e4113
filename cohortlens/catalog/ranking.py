"""Ranking metrics, subject aggregation, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import ranking
from cohortlens.operators.scale import running, banded
from cohortlens.plans import tables as t

RANK_SQL = """tie AS (SELECT {k}score, count(*) AS n, sum(CAST(label AS INTEGER)) AS pos FROM {src} GROUP BY {k}score),
cum AS (SELECT {k}n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER a AS tn, sum(pos) OVER a AS tp
  FROM tie WINDOW w AS ({part} ORDER BY score DESC), a AS ({part})),
rank_out AS (SELECT {k}CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_pos, sum(pos * (cp / cn)) / nullif(max(tp), 0) AS ap,
  CASE WHEN max(tp) > 0 AND max(tn) > max(tp) THEN sum(pos * (2 * ((tn - tp) - (cn - cp)) + (n - pos)))::DOUBLE / (2.0::DOUBLE * max(tp) * (max(tn) - max(tp))) END AS auc
  FROM cum {group})"""


def rank_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return RANK_SQL.format(
        k=k, src=src, part=f"PARTITION BY {keys}" if keys else "", group=f"GROUP BY {keys}" if keys else ""
    )


@query("a9_average_precision", f"""WITH {S.TIED}, {rank_sql('tied', 'subject')}
SELECT subject, n, n_pos, round(coalesce(ap, 0), 9) AS ap FROM rank_out""")
def average_precision(spark, d):
    out = ranking.average_precision(t.elements(spark, d, "l_discount"), ["subject"])
    return out.withColumn("ap", F.round("ap", 9))


@query("a10_average_precision_global", f"""WITH {S.ELEMENTS}, {rank_sql('elements')}
SELECT n, n_pos, round(ap, 9) AS ap FROM rank_out""")
def average_precision_global(spark, d):
    return ranking.average_precision(t.elements(spark, d)).withColumn("ap", F.round("ap", 9))


@query("a11_sampled_average_precision", f"""WITH {S.ELEMENTS},
x AS (SELECT score, label, row_number() OVER (ORDER BY score, label) - 1 AS idx, count(*) OVER () AS total FROM elements),
d AS (SELECT {S.hash_long("'73'", "k")} % (SELECT count(*) FROM elements) AS idx FROM range(5000) r(k)),
e AS (SELECT score, label FROM x JOIN d USING (idx)), {rank_sql('e')}
SELECT n, n_pos, round(ap, 9) AS ap FROM rank_out""")
def sampled_average_precision(spark, d):
    return ranking.sampled_average_precision(t.elements(spark, d), 5000, 73).withColumn("ap", F.round("ap", 9))


@query("a12_roc_auc", f"""WITH {S.TIED}, {rank_sql('tied', 'modality')}
SELECT modality, n, n_pos, round(auc, 9) AS auc FROM rank_out""")
def roc_auc(spark, d):
    out = ranking.ranking(t.elements(spark, d, "l_discount"), ["modality"])
    return out.select("modality", "n", "n_pos", F.round("auc", 9).alias("auc"))


LOSS = "-(label * ln(least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, {p}))) + (1 - label) * ln(1 - least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, {p}))))"


@query("a13_cross_entropy", f"""WITH {S.predictions(split=None)}
SELECT split, count(*) AS n, round(avg({LOSS.format(p='probability')}), 8) AS bce FROM predictions GROUP BY split""")
def cross_entropy(spark, d):
    rows = t.predictions(spark, d, split=None)
    loss = ranking.cross_entropy(F.col("label"), F.col("probability"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 8).alias("bce"))


METRIC_SQL = """, c_{src} AS (SELECT {k}count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn,
 count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, avg({loss}) AS bce
 FROM {src} {group})"""
METRIC_COLS = """n, n_pos AS n_positive, n - n_pos AS n_negative, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision, round(bce, 8) AS bce,
 round((tp + tn) / greatest(n, 1), 9) AS accuracy, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 9) AS balanced_accuracy,
 round(tp / greatest(tp + fn, 1), 9) AS sensitivity, round(tn / greatest(tn + fp, 1), 9) AS specificity, tp, tn, fp, fn"""


def metric_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return rank_sql(src, keys) + METRIC_SQL.format(
        src=src, k=k, group=f"GROUP BY {keys}" if keys else "", loss=LOSS.format(p="score")
    )


def rounded_metrics(df):
    digits = {"bce": 8}
    names = ("roc_auc", "average_precision", "bce", "accuracy", "balanced_accuracy", "sensitivity", "specificity")
    return df.withColumns({c: F.round(c, digits.get(c, 9)) for c in names})


@query("a14_binary_metrics", f"""WITH {S.predictions((1, 2), None)}, sl AS (SELECT seed, label, probability AS score FROM predictions),
{metric_sql('sl', 'seed')} SELECT seed, {METRIC_COLS} FROM rank_out JOIN c_sl USING (seed)""")
def binary_metrics(spark, d):
    return rounded_metrics(ranking.binary_metrics(t.predictions(spark, d, (1, 2), None), ["seed"], score="probability"))


@query("a15_subject_scores", f"""WITH {S.predictions(split=None)}
SELECT participant, pair_id, label, slice_count, round(score, 9) AS mean_score,
 round((SELECT median(probability) FROM predictions p WHERE p.participant = s.participant), 9) AS median_score,
 (SELECT max(probability) FROM predictions p WHERE p.participant = s.participant) AS max_score FROM subjects s""")
def subject_scores(spark, d):
    rows = t.predictions(spark, d, split=None)
    out = None
    for method in ("mean", "median", "max"):
        part = ranking.aggregate_subjects(rows, method=method).withColumnRenamed("score", f"{method}_score")
        part = part.withColumn(f"{method}_score", F.round(f"{method}_score", 9))
        out = part if out is None else out.join(part, ["participant", "pair_id", "label", "slice_count"])
    return out


@query("a16_slice_and_subject_metrics", f"""WITH {S.predictions(split=None)}, sl AS (SELECT label, probability AS score FROM predictions),
{metric_sql('sl')}, a AS (SELECT 'slice' AS unit, {METRIC_COLS} FROM rank_out, c_sl),
{metric_sql('subjects').replace('tie AS', 'tie2 AS').replace('FROM tie ', 'FROM tie2 ').replace('cum AS', 'cum2 AS').replace('FROM cum', 'FROM cum2').replace('rank_out AS', 'rank_out2 AS')}
SELECT * FROM a UNION ALL SELECT 'subject', {METRIC_COLS} FROM rank_out2, c_subjects""")
def slice_and_subject(spark, d):
    return rounded_metrics(ranking.slice_and_subject_metrics(t.predictions(spark, d, split=None)))


@query("a21_subject_balanced_loss", f"""WITH {S.predictions(split=None)}, l AS (SELECT participant, avg({LOSS.format(p='probability')}) AS l FROM predictions GROUP BY participant)
SELECT round(avg(l), 8) AS loss, count(*) AS participants FROM l""")
def balanced_loss(spark, d):
    return ranking.subject_balanced_loss(t.predictions(spark, d, split=None)).withColumn("loss", F.round("loss", 8))


RESIDUALS = """residuals AS (SELECT l_suppkey AS subject, l_linenumber AS z, l_linestatus AS modality, l_partkey % 50 AS t, l_quantity / 50 AS eps, l_discount * 10 AS eps_hat FROM lineitem)"""


def residuals(spark, d):
    """Noise and predicted noise per element, modality and timestep from the numeric columns of lineitem."""
    return t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("z"), F.col("l_linestatus").alias("modality"),
        (F.col("l_partkey") % 50).alias("t"), (F.col("l_quantity") / 50).alias("eps"),
        (F.col("l_discount") * 10).alias("eps_hat"),
    )


@query("a22_pooling", f"""WITH {RESIDUALS}, v AS (SELECT *, pow(eps - eps_hat, 2) AS v, t + 1 AS w FROM residuals)
SELECT subject, round(avg(v), 9) AS mean, round(CASE WHEN bool_or(v = 0) THEN 0 ELSE exp(avg(ln(nullif(v, 0)))) END, 9) AS geometric,
 round(max(v), 9) AS max, round(sum(v), 6) AS sum, round(sum(v * w) / sum(w), 9) AS weighted_mean FROM v GROUP BY subject""")
def pooling(spark, d):
    v = residuals(spark, d).select("subject", F.pow(F.col("eps") - F.col("eps_hat"), 2).alias("v"), (F.col("t") + 1).alias("w"))
    names = ("mean", "geometric", "max", "sum", "weighted_mean")
    return v.groupBy("subject").agg(
        *[F.round(ranking.pooling[n](F.col("v"), F.col("w")), 6 if n == "sum" else 9).alias(n) for n in names]
    )


@query("a23_two_level_pooling", f"""WITH {RESIDUALS}, v AS (SELECT subject, z, modality, avg(pow(eps - eps_hat, 2)) AS v FROM residuals GROUP BY ALL)
SELECT subject, z, round(max(v), 9) AS score FROM v GROUP BY subject, z""")
def two_level_pooling(spark, d):
    v = residuals(spark, d).withColumn("v", F.pow(F.col("eps") - F.col("eps_hat"), 2))
    return ranking.pool_two_levels(v, ["subject", "z"], "modality", "v", "mean", "max").withColumn("score", F.round("score", 9))


SCHEDULE = """schedule AS (SELECT t, alpha, exp(sum(ln(alpha)) OVER (ORDER BY t)) AS alpha_hat FROM
 (SELECT r AS t, 1 - (1e-4::DOUBLE + r * ((0.02::DOUBLE - 1e-4::DOUBLE) / 49)) AS alpha FROM range(50) x(r)))"""


@query("i14_residual_scores", f"""WITH {RESIDUALS}, {SCHEDULE}
SELECT subject, z, modality, count(*) AS n, round(1000 * avg(pow((1 - alpha) / (sqrt(1 - alpha_hat) * sqrt(alpha)) * (eps - eps_hat), 2)), 8) AS score
FROM residuals JOIN schedule USING (t) WHERE t IN (7, 12, 17, 22, 27, 32, 37, 42) GROUP BY subject, z, modality""")
def residual_scores(spark, d):
    steps = ranking.selected_timesteps(5, 45, 8)
    rows = ranking.residual_scores(residuals(spark, d), ranking.noise_schedule(spark, 50), steps)
    return rows.groupBy("subject", "z", "modality").agg(
        F.count(F.lit(1)).alias("n"), F.round(1000 * F.avg("residual"), 8).alias("score")
    )


@query("e5_schedule_products", f"""WITH {RESIDUALS}, {SCHEDULE}
SELECT t, round(alpha, 9) AS alpha, round(alpha_hat, 9) AS alpha_hat, count(*) AS n FROM residuals JOIN schedule USING (t) GROUP BY ALL""")
def schedule_products(spark, d):
    used = residuals(spark, d).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rows = used.join(ranking.noise_schedule(spark, 50), "t")
    return rows.select("t", F.round("alpha", 9).alias("alpha"), F.round("alpha_hat", 9).alias("alpha_hat"), "n")


@query("a24_seed_ensemble", f"""WITH {S.predictions((1, 2, 3), None)}, e AS (SELECT participant, label, round(avg(score), 12) AS score FROM subjects GROUP BY ALL HAVING count(*) = 3),
{metric_sql('e')} SELECT 'PASS' AS status, {METRIC_COLS} FROM rank_out, c_e""")
def seed_ensemble(spark, d):
    subjects = ranking.aggregate_subjects(t.predictions(spark, d, (1, 2, 3), None), ["seed"]).withColumn("cell", F.lit("all"))
    rows, status = ranking.seed_ensemble(subjects, ["cell"], (1, 2, 3))
    metrics = rounded_metrics(ranking.binary_metrics(rows, ["cell"]))
    return metrics.join(status.select("cell", "status"), "cell").drop("cell")


@query("x1_aggregator_registry", f"""WITH {RESIDUALS}, v AS (SELECT modality, pow(eps - eps_hat, 2) AS v FROM residuals)
SELECT modality, 'arithmetic_mean' AS aggregator, round(avg(v), 9) AS value FROM v GROUP BY modality UNION ALL
SELECT modality, 'maximum', round(max(v), 9) FROM v GROUP BY modality UNION ALL
SELECT modality, 'gmean', round(CASE WHEN bool_or(v = 0) THEN 0 ELSE exp(avg(ln(nullif(v, 0)))) END, 9) FROM v GROUP BY modality""")
def aggregator_registry(spark, d):
    v = residuals(spark, d).select("modality", F.pow(F.col("eps") - F.col("eps_hat"), 2).alias("v"))
    names = ("arithmetic_mean", "maximum", "gmean")
    wide = v.groupBy("modality").agg(*[F.round(ranking.pooling[n](F.col("v")), 9).alias(n) for n in names])
    return wide.unpivot("modality", list(names), "aggregator", "value")


@query("e3_running_counts", f"""WITH {S.TIED}, tie AS (SELECT subject, score, count(*) AS n FROM tied GROUP BY ALL)
SELECT subject, CAST(score AS DOUBLE) AS score, n, CAST(sum(n) OVER (PARTITION BY subject ORDER BY score) - n AS BIGINT) AS n_before,
 CAST(sum(n) OVER (PARTITION BY subject) AS BIGINT) AS n_total FROM tie""")
def running_counts(spark, d):
    ties = t.elements(spark, d, "l_discount").groupBy("subject", "score").agg(F.count(F.lit(1)).alias("n"))
    return running(banded(ties, "score"), ["subject"], ["score"], ["n"]).withColumn("score", F.col("score").cast("double"))
