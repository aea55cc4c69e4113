"""The logistic control, its permutation null, and negative-control cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.catalog.ranking import LOSS, rank_sql
from cohortlens.operators import controls, model, ranking
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t

FEATURES = ("support", "z_norm", "u")


def model_rows(spark, d):
    """Paired slices with three features, one of them informative."""
    mapped = t.split_records(spark, d, ["participant", "case_id", "z", "z_norm", "z_bin", "label", "support", "record_id"])
    rows = t.paired_records(spark, d, mapped)
    return staged(rows.select("split", "pair_id", "participant", "record_id", "label", "support", "z_norm", t.probability("7", "record_id", F.col("label")).alias("u")))


# Refits of the permutation null: p can go down to 0.01.
REFITS = 99


def newton_sql(refits: int) -> str:
    """CTEs ``scaled`` (standardized rows with weights) and ``beta`` (r, b1, b2, b3, b4): r = -1 has the true labels."""
    x = ("x1", "x2", "x3", "1.0::DOUBLE")
    z = "b1 * x1 + b2 * x2 + b3 * x3 + b4"
    g = ", ".join(f"sum(w * (p - y) * {a})" + (f" + any_value(b{i})" if i < 4 else "") + f" AS g{i}" for i, a in enumerate(x, 1))
    h = ", ".join(f"sum(w * p * (1 - p) * {a} * {b})" + (" + 1" if i == k < 4 else "") + f" AS h{i}{k}" for i, a in enumerate(x, 1) for k, b in enumerate(x, 1) if k <= i)
    return f"""{S.PAIRS}, feat AS (SELECT split, pair_id, participant, label, support, z_norm, {S.probability("'7'")} AS u FROM paired),
st AS (SELECT avg(support) AS m1, stddev_pop(support) AS s1, avg(z_norm) AS m2, stddev_pop(z_norm) AS s2, avg(u) AS m3, stddev_pop(u) AS s3 FROM feat WHERE split = 'train'),
scaled AS MATERIALIZED (SELECT split, pair_id, participant, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY split, participant) AS w,
  (support - m1) / s1 AS x1, (z_norm - m2) / s2 AS x2, (u - m3) / s3 AS x3 FROM feat, st),
tr AS MATERIALIZED (SELECT r, x1, x2, x3, w, CASE WHEN r >= 0 THEN CAST(xor(label, {S.hash_long("('73:' || r || ':train')", "pair_id")} % 2) AS INTEGER) ELSE label END AS y
  FROM scaled, range(-1, {refits}) t(r) WHERE split = 'train'),
it(step, r, b1, b2, b3, b4) AS (
  SELECT 0, r, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM range(-1, {refits}) t(r)
  UNION ALL
  SELECT step, r, b1 - d1, b2 - d2, b3 - d3, b4 - d4 FROM (
    SELECT *, sqrt(h11) AS l11, h21 / l11 AS l21, h31 / l11 AS l31, h41 / l11 AS l41, sqrt(h22 - l21 * l21) AS l22, (h32 - l31 * l21) / l22 AS l32,
      (h42 - l41 * l21) / l22 AS l42, sqrt(h33 - l31 * l31 - l32 * l32) AS l33, (h43 - l41 * l31 - l42 * l32) / l33 AS l43,
      sqrt(h44 - l41 * l41 - l42 * l42 - l43 * l43) AS l44, g1 / l11 AS y1, (g2 - l21 * y1) / l22 AS y2, (g3 - l31 * y1 - l32 * y2) / l33 AS y3,
      (g4 - l41 * y1 - l42 * y2 - l43 * y3) / l44 AS y4, y4 / l44 AS d4, (y3 - l43 * d4) / l33 AS d3, (y2 - l32 * d3 - l42 * d4) / l22 AS d2,
      (y1 - l21 * d2 - l31 * d3 - l41 * d4) / l11 AS d1
    FROM (SELECT step + 1 AS step, r, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, any_value(b4) AS b4, {g}, {h}
      FROM (SELECT it.*, x1, x2, x3, w, y, 1 / (1 + exp(-({z}))) AS p FROM it JOIN tr USING (r) WHERE step < {model.STEPS}) GROUP BY step, r))
), beta AS (SELECT * FROM it WHERE step = {model.STEPS})"""


@query("v14_weighted_logistic", f"""WITH RECURSIVE {newton_sql(0)},
sub AS (SELECT split, participant, label, round(avg(1 / (1 + exp(-(b1 * x1 + b2 * x2 + b3 * x3 + b4)))), 12) AS score FROM scaled, beta GROUP BY split, participant, label),
{rank_sql('sub', 'split')}, loss AS (SELECT split, avg({LOSS.format(p='score')}) AS bce FROM sub GROUP BY split)
SELECT split, n, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(bce, 6) AS bce FROM rank_out JOIN loss USING (split)""")
def weighted_logistic(spark, d):
    held = model.held_out_scores(model_rows(spark, d), FEATURES)
    out = ranking.binary_metrics(ranking.aggregate_subjects(held, ["split"]), ["split"])
    return out.select("split", "n", F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"), F.round("bce", 6).alias("bce"))


@query("v15_permutation_null", f"""WITH RECURSIVE {newton_sql(REFITS)},
sub AS (SELECT r, participant, label, round(avg(1 / (1 + exp(-(b1 * x1 + b2 * x2 + b3 * x3 + b4)))), 12) AS score FROM scaled, beta WHERE split = 'test' GROUP BY r, participant, label),
{rank_sql('sub', 'r')}, o AS (SELECT auc AS observed FROM rank_out WHERE r = -1), nul AS (SELECT auc FROM rank_out WHERE r >= 0)
SELECT round(observed, 6) AS observed_auc, count(*) AS replicates, round(avg(auc), 6) AS null_mean, 'complete' AS status,
 round((1 + count(*) FILTER (WHERE abs(auc - 0.5) >= abs(observed - 0.5) - 1e-15)) / (1 + count(*)), 6) AS p_value FROM nul, o GROUP BY observed""")
def permutation_null(spark, d):
    null, observed = model.permutation_test(model_rows(spark, d), FEATURES, range(REFITS), 73)
    out = model.permutation_p_value(null, observed, REFITS)
    return out.select(F.round("observed_auc", 6).alias("observed_auc"), "replicates", F.round("null_mean", 6).alias("null_mean"), "status", F.round("p_value", 6).alias("p_value"))


def split_records(spark, d):
    return t.split_records(spark, d)


def cohort_sql(keys: str) -> str:
    """Same-cohort pairs of a table ``cohort`` by rounds over all pairs of classes; ``keys`` without an alias."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    of = lambda alias: ", ".join(f"{alias}.{k}" for k in keys.split(", "))
    return f"""prof AS (SELECT {keys}, participant, list_sort(list(DISTINCT z_bin)) AS bins, CAST(round(sum(z_bin) / count(*) * {controls.MEAN_GRID}) AS INTEGER) AS mean_cell FROM cohort GROUP BY ALL),
halves AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5('73|' || participant), participant) - 1 AS r, count(*) OVER (PARTITION BY {keys}) // 2 AS half FROM prof),
ppl AS (SELECT *, CASE WHEN r < half THEN 0 ELSE 1 END AS side, array_to_string(bins, ',') || ':' || mean_cell AS cls FROM halves WHERE r < 2 * half),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys}, side, cls ORDER BY md5('73:class|' || participant), participant) - 1 AS rank FROM ppl),
cl AS (SELECT {keys}, side, cls, any_value(bins) AS bins, any_value(mean_cell) AS mean_cell, count(*) AS size FROM ppl GROUP BY {keys}, side, cls),
cand AS (SELECT {of("a")}, a.cls AS c0, b.cls AS c1, a.size AS s0, b.size AS s1, len(list_intersect(a.bins, b.bins)) AS common,
  row_number() OVER (PARTITION BY {of("a")} ORDER BY common DESC, abs(a.mean_cell - b.mean_cell), a.cls <> b.cls, md5('73:tie|' || a.cls || '|' || b.cls), a.cls, b.cls) AS ord FROM cl a JOIN cl b ON {on} AND a.side = 0 AND b.side = 1 WHERE common > 0),
it AS (SELECT {keys}, c0, c1, ord, s0, s1, 0::BIGINT AS u0, 0::BIGINT AS u1, 0::BIGINT AS amount, 0::BIGINT AS from0, 0::BIGINT AS from1 FROM cand
  UNION ALL SELECT {keys}, c0, c1, ord, s0, s1, u0 + max(take) OVER (PARTITION BY {keys}, c0), u1 + max(take) OVER (PARTITION BY {keys}, c1), take, u0, u1
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {keys}, c0 ORDER BY ord) = 1 AND row_number() OVER (PARTITION BY {keys}, c1 ORDER BY ord) = 1 THEN least(s0 - u0, s1 - u1) ELSE 0 END AS take FROM it WHERE u0 < s0 AND u1 < s1)),
pr AS (SELECT {of("a")}, a.participant AS p0, b.participant AS p1 FROM it JOIN rk a ON {on.replace("b.", "it.")} AND a.side = 0 AND a.cls = c0 AND a.rank >= from0 AND a.rank < from0 + amount
  JOIN rk b ON {on} AND b.side = 1 AND b.cls = c1 AND b.rank = a.rank - from0 + from1 WHERE amount > 0),
mem AS (SELECT concat_ws(':', 'negative', {keys}, substr(sha256(p0 || '|' || p1), 1, 12)) AS pair_id, {keys}, unnest([p0, p1]) AS participant, unnest([0, 1]) AS label FROM pr),
cap AS (SELECT * EXCLUDE (label), row_number() OVER (PARTITION BY {keys}, participant, z_bin ORDER BY z, record_id) AS k FROM cohort QUALIFY k <= 2),
bal AS (SELECT {keys}, pair_id, participant, label, z_bin, z, record_id, k, least(count(*) FILTER (WHERE label = 0) OVER w, count(*) FILTER (WHERE label = 1) OVER w) AS keep FROM cap JOIN mem USING ({keys}, participant) WINDOW w AS (PARTITION BY pair_id, z_bin))
SELECT {keys}, pair_id, participant, label, z_bin, z, record_id FROM bal WHERE k <= keep"""


@query("l10_same_cohort_pairs", f"WITH RECURSIVE {S.SPLITS}, cohort AS (SELECT r.*, split FROM records r JOIN split_map USING (participant) WHERE label = 0), {cohort_sql('split')}")
def same_cohort_pairs(spark, d):
    out = controls.same_cohort_pairs(split_records(spark, d).where("label = 0"), 73)
    return out.select("split", "pair_id", "participant", "label", "z_bin", "z", "record_id")


@query("l11_source_stratified_pairs", f"""WITH RECURSIVE {S.RECORDS}, sp AS (SELECT source, participant, row_number() OVER (PARTITION BY source ORDER BY md5('73:split|' || participant), participant) - 1 AS r, count(*) OVER (PARTITION BY source) // 2 AS h FROM (SELECT DISTINCT source, participant FROM records WHERE label = 0)),
sh AS (SELECT source, i, f, floor(h * f) AS base, h - sum(floor(h * f)) OVER (PARTITION BY source) AS rest, row_number() OVER (PARTITION BY source ORDER BY h * f - floor(h * f) DESC, i) AS nth FROM (SELECT DISTINCT source, h FROM sp), (VALUES (0, 0.40::DOUBLE), (1, 0.10::DOUBLE), (2, 0.50::DOUBLE)) v(i, f)),
upto AS (SELECT source, i, sum(2 * (base + CASE WHEN nth <= rest THEN 1 ELSE 0 END)) OVER (PARTITION BY source ORDER BY i) AS n FROM sh),
fresh AS (SELECT source, participant, ['train', 'val', 'test'][min(i) + 1] AS split FROM sp JOIN upto USING (source) WHERE r < n GROUP BY ALL), cohort AS (SELECT r.*, split FROM records r JOIN fresh USING (source, participant) WHERE label = 0), {cohort_sql('source, split')}""")
def source_stratified_pairs(spark, d):
    rows = t.records(spark, d).where("label = 0").select("source", "participant", "label", "z_bin", "z", "record_id")
    out = controls.source_stratified_pairs(rows, 73)
    return out.select("source", "split", "pair_id", "participant", "label", "z_bin", "z", "record_id")


def control_slices(spark, d):
    """Low slices of one source and three pools of other slices, one slice per (case, z)."""
    rows = t.records(spark, d).select(
        F.lit("all").alias("partition"), F.col("record_id").alias("key"), "case_id", "z", (F.col("support") * 0.9 + (F.col("source_key") % 10) / 100).alias("support"), "source")
    pool = F.when(F.col("source") == 1, "a").when(F.col("source") == 2, "b").when(F.col("source") == 3, "c")
    return rows.where("source = 0").drop("source"), rows.withColumn("pool", pool).where("pool IS NOT NULL").drop("source")


@query("j11_matched_controls")
def matched_controls(spark, d):
    low, pools = control_slices(spark, d)
    out = controls.matched_controls(low, pools, 73)
    return out.select("key", "pool", "control", F.round("distance", 9).alias("distance"))
