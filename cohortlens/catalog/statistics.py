"""Bootstrap, swap tests, Holm, gates, run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.catalog.ranking import METRIC_COLS, metric_sql, rank_sql, rounded_metrics
from cohortlens.operators import gates, ranking, resampling, splits
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t

# Fixed values of the study: bootstrap replicates, label swaps, swaps of ensembles.
REPLICATES, SWAPS, ENSEMBLE_SWAPS = 2000, 1000, 9999
SEEDS = (1, 2, 3)
NULL_SEEDS = (11, 12, 13)


def subjects(spark, d, seeds=SEEDS):
    return staged(ranking.aggregate_subjects(t.predictions(spark, d, seeds), ["seed"]))


def tie_stats(src, keys):
    """Weighted AUC per key in SQL; ``src`` has (keys, score, label, m)."""
    k = ", ".join(keys)
    return f"""t_{src} AS (SELECT {k}, score, sum(m) AS n, sum(m * label) AS pos FROM {src} GROUP BY {k}, score),
k_{src} AS (SELECT *, sum(n - pos) OVER (PARTITION BY {k} ORDER BY score) - (n - pos) AS below, sum(pos) OVER (PARTITION BY {k}) AS tp,
  sum(n) OVER (PARTITION BY {k}) AS tn FROM t_{src}),
auc_{src} AS (SELECT {k}, CASE WHEN max(tp) > 0 AND max(tn) > max(tp) THEN sum(pos * (2 * below + (n - pos)))::DOUBLE / (2.0::DOUBLE * max(tp) * (max(tn) - max(tp))) END AS auc
  FROM k_{src} GROUP BY {k})"""


def boot_sql(seeds):
    return f"""{S.predictions(seeds)}, sub AS (SELECT seed, pair_id, label, score, 1 AS m FROM subjects),
pt AS (SELECT seed, pair_id, max(score) FILTER (WHERE label = 0) AS s0, max(score) FILTER (WHERE label = 1) AS s1 FROM sub GROUP BY seed, pair_id),
u AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5('units|' || pair_id), pair_id) - 1 AS u, count(*) OVER (PARTITION BY seed) AS n FROM pt),
dr AS (SELECT seed, b, {S.hash_long("'73'", "b || '|' || u")} % n AS u FROM u, range(1, {REPLICATES} + 1) r(b)),
mu AS (SELECT seed, b, u, count(*) AS m FROM dr GROUP BY ALL),
rows_b AS (SELECT mu.seed, b, 0 AS label, s0 AS score, m FROM mu JOIN u USING (seed, u) UNION ALL SELECT mu.seed, b, 1, s1, m FROM mu JOIN u USING (seed, u)),
{tie_stats('rows_b', ['seed', 'b'])}, {tie_stats('sub', ['seed'])},
boot AS (SELECT seed, count(auc) AS n_valid, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 1 - 0.025::DOUBLE) AS ci_high FROM auc_rows_b GROUP BY seed)"""


def swap_sql(swaps=SWAPS):
    bit = f"({S.hash_long(chr(39) + '73' + chr(39), 'b || ' + chr(39) + '|' + chr(39) + ' || pair_id')} % 2)"
    return f"""fl AS (SELECT seed, b, pair_id, CASE WHEN {bit} = 1 THEN s1 ELSE s0 END AS s0, CASE WHEN {bit} = 1 THEN s0 ELSE s1 END AS s1
  FROM pt, range(1, {swaps} + 1) r(b)),
rows_s AS (SELECT seed, b, 0 AS label, s0 AS score, 1 AS m FROM fl UNION ALL SELECT seed, b, 1, s1, 1 FROM fl),
{tie_stats('rows_s', ['seed', 'b'])},
swap AS (SELECT s.seed, abs(any_value(o.auc) - 0.5) AS deviation, (1 + count(*) FILTER (WHERE abs(s.auc - 0.5) >= abs(o.auc - 0.5) - 1e-15)) / (1 + count(s.auc)) AS p_value,
  count(s.auc) AS n_valid, avg(s.auc) AS null_mean, quantile_cont(s.auc, 0.025) AS null_low, quantile_cont(s.auc, 0.975) AS null_high
  FROM auc_rows_s s JOIN auc_sub o ON s.seed = o.seed GROUP BY s.seed)"""


@query("v1_paired_bootstrap", f"""WITH {boot_sql(SEEDS)}
SELECT seed, round(auc, 9) AS observed_auc, n_valid, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, (SELECT count(*) FROM pt WHERE pt.seed = boot.seed) AS n_units
FROM boot JOIN auc_sub USING (seed)""")
def paired_bootstrap(spark, d):
    out = resampling.bootstrap_auc(subjects(spark, d), ["seed"], REPLICATES)
    return out.withColumns({c: F.round(c, 9) for c in ("observed_auc", "ci_low", "ci_high")})


@query("v1_subject_bootstrap", f"""WITH {S.predictions()}, u AS (SELECT participant, label, score, row_number() OVER (ORDER BY md5('units|' || participant), participant) - 1 AS u, count(*) OVER () AS n FROM subjects),
dr AS (SELECT b, {S.hash_long("'73'", "b || '|' || u")} % n AS u FROM u, range(1, {REPLICATES} + 1) r(b)), mu AS (SELECT b, u, count(*) AS m FROM dr GROUP BY ALL),
rows_b AS (SELECT b, label, score, m FROM mu JOIN u USING (u)), {tie_stats('rows_b', ['b'])},
sub AS (SELECT 1 AS one, label, score, 1 AS m FROM subjects), {tie_stats('sub', ['one'])}
SELECT round((SELECT auc FROM auc_sub), 9) AS observed_auc, count(auc) AS n_valid, round(quantile_cont(auc, 0.025), 9) AS ci_low,
 round(quantile_cont(auc, 1 - 0.025::DOUBLE), 9) AS ci_high, (SELECT count(*) FROM subjects) AS n_units FROM auc_rows_b""")
def subject_bootstrap(spark, d):
    out = resampling.bootstrap_auc(subjects(spark, d, (1,)).drop("seed"), [], REPLICATES, paired=False)
    return out.withColumns({c: F.round(c, 9) for c in ("observed_auc", "ci_low", "ci_high")})


@query("v2_pair_swap_test", f"""WITH {boot_sql(SEEDS)}, {swap_sql()}
SELECT seed, round(auc, 9) AS observed_auc, round(deviation, 9) AS deviation, round(p_value, 9) AS p_value, n_valid, 'complete' AS status,
 round(null_mean, 9) AS null_mean, round(null_low, 9) AS null_low, round(null_high, 9) AS null_high, (SELECT count(*) FROM pt WHERE pt.seed = swap.seed) AS n_pairs
FROM swap JOIN auc_sub USING (seed)""")
def pair_swap(spark, d):
    out = resampling.swap_test(subjects(spark, d), ["seed"], SWAPS)
    return out.withColumns({c: F.round(c, 9) for c in ("observed_auc", "deviation", "p_value", "null_mean", "null_low", "null_high")})


P_VALUES = """p AS (SELECT l_linenumber AS family, l_suppkey AS test, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE min(l_tax) / 50 + count(*) / 100000.0::DOUBLE END AS p_value
 FROM lineitem GROUP BY 1, 2)"""
HOLM = """s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value) + 1) * p_value) AS step FROM p WHERE p_value IS NOT NULL),
h AS (SELECT family, test, max(step) OVER (PARTITION BY family ORDER BY p_value) AS p_holm FROM s)"""


def p_values(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("family"), F.col("l_suppkey").alias("test"))
    p = F.min("l_tax") / 50 + F.count(F.lit(1)) / 100000.0
    return rows.agg(p.alias("p")).select("family", "test", F.when(F.col("test") % 17 != 0, F.col("p")).alias("p_value"))


@query("v3_holm", f"""WITH {P_VALUES}, {HOLM} SELECT family, test, round(p_value, 12) AS p_value, round(p_holm, 9) AS p_holm FROM p LEFT JOIN h USING (family, test)""")
def holm(spark, d):
    out = resampling.holm_large(p_values(spark, d), ["family"])
    return out.select("family", "test", F.round("p_value", 12).alias("p_value"), F.round("p_holm", 9).alias("p_holm"))


@query("v4_holm_complete_family", f"""WITH {P_VALUES.replace("l_suppkey % 17 = 0", "l_suppkey % 17 = 0 AND l_linenumber > 3")}, {HOLM},
c AS (SELECT family, count(*) = (SELECT count(DISTINCT l_suppkey) FROM lineitem) AND count(p_value) = count(*) AS ok FROM p GROUP BY family)
SELECT family, test, CASE WHEN ok THEN 'PASS' ELSE 'INCONCLUSIVE' END AS family_status, CASE WHEN ok THEN round(p_holm, 9) END AS p_holm FROM p LEFT JOIN h USING (family, test) JOIN c USING (family)""")
def holm_complete(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("family"), F.col("l_suppkey").alias("test"))
    p = (F.min("l_tax") / 50 + F.count(F.lit(1)) / 100000.0).alias("p")
    missing = (F.col("test") % 17 == 0) & (F.col("family") > 3)
    values = rows.agg(p).select("family", "test", F.when(~missing, F.col("p")).alias("p_value"))
    expected = t.table(spark, d, "lineitem").select("l_suppkey").distinct().count()
    out = resampling.holm_if_complete(values, ["family"], expected)
    return out.select("family", "test", "family_status", F.round("p_holm", 9).alias("p_holm"))


@query("v5_case_bootstrap", f"""WITH c AS (SELECT l_suppkey AS case_id, l_linestatus AS modality, l_returnflag AS grp, avg(l_extendedprice) / 1000 AS value FROM lineitem GROUP BY ALL),
u AS (SELECT case_id, row_number() OVER (ORDER BY md5('units|' || case_id), case_id) - 1 AS u, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM c)),
dr AS (SELECT b, {S.hash_long("'73'", "b || '|' || u")} % n AS u FROM u, range(1, {REPLICATES} + 1) r(b)), w AS (SELECT b, u, count(*) AS m FROM dr GROUP BY ALL),
x AS (SELECT modality, b, coalesce(sum(m * value) FILTER (WHERE grp = 'A'), 0) / greatest(coalesce(sum(m) FILTER (WHERE grp = 'A'), 0), 1)
   - coalesce(sum(m * value) FILTER (WHERE grp = 'R'), 0) / greatest(coalesce(sum(m) FILTER (WHERE grp = 'R'), 0), 1) AS d
  FROM c JOIN u USING (case_id) JOIN w USING (u) GROUP BY modality, b),
q AS (SELECT modality, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high FROM x GROUP BY modality)
SELECT modality, round(avg(value) FILTER (WHERE grp = 'A') - avg(value) FILTER (WHERE grp = 'R'), 6) AS difference, round(any_value(ci_low), 6) AS ci_low, round(any_value(ci_high), 6) AS ci_high
FROM c JOIN q USING (modality) GROUP BY modality""")
def case_bootstrap(spark, d):
    rows = t.intensities(spark, d).groupBy("case_id", "modality", "cohort").agg((F.avg("v") / 1000).alias("value"))
    out = resampling.case_bootstrap(rows, ["modality"], "cohort", ("A", "R"), REPLICATES, 73)
    return out.withColumns({c: F.round(c, 6) for c in ("difference", "ci_low", "ci_high")})


RATE_ROWS = """sr AS (SELECT l_linestatus AS model, l_linenumber AS seed, avg(l_discount) * {a} AS accuracy, CASE WHEN l_linenumber < 7 OR l_linestatus = 'O' THEN avg(l_tax) END AS bce FROM lineitem GROUP BY l_linestatus, l_linenumber)"""
REDUCE = """CASE WHEN bool_or(NOT passed) THEN 'FAIL' WHEN bool_and(coalesce(passed, false)) THEN 'PASS' ELSE 'INCONCLUSIVE' END AS status"""


@query("v6_tiny_gate", f"""WITH {RATE_ROWS.format(a=20)}, j AS (SELECT *, CASE WHEN bce IS NOT NULL THEN accuracy >= 0.99 AND bce <= 0.05 END AS passed FROM sr)
SELECT model, count(*) AS n_seeds, count(*) FILTER (WHERE passed) AS n_passed, {REDUCE} FROM j GROUP BY model""")
def tiny_gate(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("seed"))
    rows = rows.agg((F.avg("l_discount") * 20).alias("accuracy"), F.avg("l_tax").alias("b"))
    rows = rows.withColumn("bce", F.when((F.col("seed") < 7) | (F.col("model") == "O"), F.col("b")))
    return gates.tiny_gate(rows, ["model"], 0.99, 0.05)


@query("v7_positive_gate", f"""WITH {boot_sql(SEEDS)}, j AS (SELECT seed, auc >= 0.55 AND ci_low > 0.40 AS passed FROM boot JOIN auc_sub USING (seed))
SELECT count(*) AS n_seeds, count(*) FILTER (WHERE passed) AS n_passed, {REDUCE} FROM j""")
def positive_gate(spark, d):
    boot = resampling.bootstrap_auc(subjects(spark, d), ["seed"], REPLICATES).withColumnRenamed("observed_auc", "auc")
    return gates.positive_gate(boot, [], 0.55, 0.40)


NEGATIVE_SQL = """n AS (SELECT b.seed, o.auc, ci_low, ci_high, p_value, deviation FROM boot b JOIN auc_sub o ON b.seed = o.seed JOIN swap s ON b.seed = s.seed),
st AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) * p_value) AS step FROM n),
hh AS (SELECT *, max(step) OVER (ORDER BY p_value) AS p_holm FROM st),
g AS (SELECT count(*) AS n_seeds, count(*) FILTER (WHERE p_holm < 0.01) AS p_failures, count(*) FILTER (WHERE deviation >= 0.15) AS deviation_seeds,
  bool_and(ci_low >= 0.35 AND ci_high <= 0.65) AS ci_ready, true AS swap_ready, max(greatest(ci_high, 1 - ci_low)) AS up FROM hh)"""


@query("v8_negative_gate", f"""WITH {boot_sql(NULL_SEEDS)}, {swap_sql()}, {NEGATIVE_SQL}
SELECT n_seeds, p_failures, deviation_seeds, ci_ready, swap_ready, round(up, 9) AS direction_invariant_upper,
 CASE WHEN p_failures > 0 OR deviation_seeds >= 2 THEN 'FAIL' WHEN ci_ready AND swap_ready THEN 'PASS' ELSE 'INCONCLUSIVE' END AS status,
 CASE WHEN p_failures = 0 AND deviation_seeds < 2 AND ci_ready AND swap_ready AND up < 0.60 THEN 'PASS' ELSE 'INCONCLUSIVE' END AS closeness_status FROM g""")
def negative_gate(spark, d):
    rows = gates.seed_statistics(subjects(spark, d, NULL_SEEDS), ["seed"], REPLICATES, SWAPS)
    return gates.negative_gate(rows, []).withColumn("direction_invariant_upper", F.round("direction_invariant_upper", 9))


DIRECTION = """round(greatest(auc, 1 - auc), 9) AS direction_auc, round(greatest(0.5::DOUBLE, least(ci_low, 1 - ci_high)), 9) AS direction_low, round(greatest(ci_high, 1 - ci_low), 9) AS direction_high"""


@query("v9_direction_invariant", f"""WITH {boot_sql(SEEDS)} SELECT seed, {DIRECTION} FROM boot JOIN auc_sub USING (seed)""")
def direction_invariant(spark, d):
    boot = resampling.bootstrap_auc(subjects(spark, d), ["seed"], REPLICATES).withColumnRenamed("observed_auc", "auc")
    return boot.select("seed", *[F.round(c, 9).alias(n) for n, c in gates.direction_invariant().items()])


CONTROLS = """ctl AS (SELECT s AS seed, max(l_tax) FILTER (WHERE l_linenumber % 3 + 1 = s) > 0.05 AS tiny, CASE WHEN s = 3 THEN NULL ELSE count(*) > 0 END AS positive, true AS negative, true AS permutation
 FROM lineitem, (VALUES (1), (2), (3)) v(s) GROUP BY s)"""


@query("v10_run_summary", f"""WITH {boot_sql(SEEDS)}, {CONTROLS},
cnt AS (SELECT seed, count(*) AS test_subjects, CAST(sum(slice_count) AS BIGINT) AS test_slices FROM subjects GROUP BY seed),
r AS (SELECT seed, test_subjects, test_slices, auc, ci_low, ci_high, CASE WHEN NOT tiny OR NOT positive OR NOT negative OR NOT permutation THEN 'FAIL'
  WHEN tiny AND positive AND negative AND permutation THEN 'PASS' ELSE 'INCONCLUSIVE' END AS control_gate_status FROM boot JOIN auc_sub USING (seed) JOIN cnt USING (seed) JOIN ctl USING (seed))
SELECT seed, test_subjects, test_slices, round(auc, 9) AS auc, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, {DIRECTION}, control_gate_status,
 CASE WHEN control_gate_status <> 'PASS' THEN 'INCONCLUSIVE' WHEN greatest(ci_high, 1 - ci_low) < 0.60 THEN 'PASS' ELSE 'FAIL' END AS low_separability_status,
 CASE WHEN control_gate_status = 'PASS' THEN 'COMPLETE' ELSE 'INCONCLUSIVE' END AS evidence_status FROM r""")
def run_summary(spark, d):
    people = subjects(spark, d)
    counts = people.groupBy("seed").agg(F.count(F.lit(1)).alias("test_subjects"), F.sum("slice_count").alias("test_slices"))
    boot = resampling.bootstrap_auc(people, ["seed"], REPLICATES).withColumnRenamed("observed_auc", "auc")
    tiny = t.table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 3 + 1).alias("seed"))
    controls = tiny.agg((F.max("l_tax") > 0.05).alias("tiny"), (F.count(F.lit(1)) > 0).alias("p")).select(
        "seed", "tiny", F.when(F.col("seed") != 3, F.col("p")).alias("positive"),
        F.lit(True).alias("negative"), F.lit(True).alias("permutation"),
    )
    rows = boot.join(counts, "seed").join(controls, "seed", "left")
    out = gates.apply_gates(rows, ["tiny", "positive", "negative", "permutation"])
    numbers = ("auc", "ci_low", "ci_high", "direction_auc", "direction_low", "direction_high")
    return out.select(
        "seed", "test_subjects", "test_slices", *[F.round(c, 9).alias(c) for c in numbers],
        "control_gate_status", "low_separability_status", "evidence_status",
    )


@query("v10_slice_metrics", f"""WITH {S.predictions(SEEDS)}, sl AS (SELECT seed, label, probability AS score FROM predictions), {metric_sql('sl', 'seed')}, a AS (SELECT seed, 'slice' AS unit, {METRIC_COLS} FROM rank_out JOIN c_sl USING (seed)),
{metric_sql('subjects', 'seed').replace('tie AS', 'tie2 AS').replace('FROM tie ', 'FROM tie2 ').replace('cum AS', 'cum2 AS').replace('FROM cum', 'FROM cum2').replace('rank_out AS', 'rank_out2 AS')}
SELECT * FROM a UNION ALL SELECT seed, 'subject', {METRIC_COLS} FROM rank_out2 JOIN c_subjects USING (seed)""")
def run_slice_metrics(spark, d):
    """The metric columns of the run summary, per seed, of slices and of subjects."""
    return rounded_metrics(ranking.slice_and_subject_metrics(staged(t.predictions(spark, d, SEEDS)), ["seed"]))


ENSEMBLE = boot_sql(SEEDS).replace(
    "sub AS (SELECT seed, pair_id, label, score, 1 AS m FROM subjects)",
    "sub AS (SELECT 0 AS seed, pair_id, label, round(avg(score), 12) AS score, 1 AS m FROM subjects GROUP BY pair_id, participant, label)",
)


@query("v11_ensemble_statistics", f"""WITH {ENSEMBLE}, {swap_sql(ENSEMBLE_SWAPS)} SELECT 'all' AS cell, round(auc, 9) AS auc, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_value, 9) AS p_value,
 (SELECT count(*) FROM pt) AS n_pairs, 'complete' AS swap_status FROM boot JOIN auc_sub USING (seed) JOIN swap USING (seed)""")
def ensemble_statistics(spark, d):
    people = subjects(spark, d).withColumn("cell", F.lit("all"))
    rows, _ = ranking.seed_ensemble(people, ["cell"], SEEDS)
    out = gates.seed_statistics(staged(rows), ["cell"], REPLICATES, ENSEMBLE_SWAPS)
    return out.select("cell", *[F.round(c, 9).alias(c) for c in ("auc", "ci_low", "ci_high", "p_value")], "n_pairs", "swap_status")


@query("v12_family_summary", f"""WITH {boot_sql(SEEDS)}, {swap_sql()},
st AS (SELECT seed, p_value, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) * p_value) AS step FROM swap)
SELECT seed, round(p_value, 9) AS p_value, round(max(step) OVER (ORDER BY p_value), 9) AS p_holm, 'PASS' AS family_status FROM st""")
def family_summary(spark, d):
    cells = resampling.swap_test(subjects(spark, d), ["seed"], SWAPS).withColumn("family", F.lit("seeds"))
    out = gates.family_summary(cells, ["family"], len(SEEDS))
    return out.select("seed", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"), "family_status")


def student_sql(r: str) -> str:
    """Two-sided p by the integral of cos^(n - 3) from asin |r| to a right angle (Simpson's rule)."""
    return f"""(SELECT 2 * exp(lgamma((points - 1) / 2.0::DOUBLE) - lgamma((points - 2) / 2.0::DOUBLE) - lgamma(0.5::DOUBLE)) * w / 3
 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((points - 3) * ln(greatest(1e-300::DOUBLE, cos(asin(abs({r})) + i * w)))))
 FROM (SELECT (pi() / 2 - asin(abs({r}))) / 20000 AS w), range(0, 20001) t(i) GROUP BY w)"""


@query("v13_correlations", f"""WITH v AS (SELECT 'quantity_price' AS pair, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'discount_tax', l_discount, l_tax FROM lineitem),
r AS (SELECT pair, x, y, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0::DOUBLE AS ry FROM v),
c AS (SELECT pair, count(*) AS points, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY pair)
SELECT pair, points, round(pearson, 9) AS pearson, round(spearman, 9) AS spearman, round({student_sql('pearson')}, 7) AS pearson_p, round({student_sql('spearman')}, 7) AS spearman_p FROM c""")
def correlations(spark, d):
    rows = t.table(spark, d, "lineitem")
    both = [gates.correlations(rows, x, y).withColumn("pair", F.lit(name)) for name, x, y in (("quantity_price", "l_quantity", "l_extendedprice"), ("discount_tax", "l_discount", "l_tax"))]
    out = both[0].unionByName(both[1])
    return out.select("pair", "points", *[F.round(c, 9).alias(c) for c in ("pearson", "spearman")], *[F.round(c, 7).alias(c) for c in ("pearson_p", "spearman_p")])


@query("g14_status_reducer", f"""WITH j AS (SELECT p_brand AS run, p_type AS part, CASE WHEN avg(p_size) > 30 THEN NULL ELSE avg(p_size) > 18 END AS passed FROM part GROUP BY ALL)
SELECT run, {REDUCE} FROM j GROUP BY run""")
def status_reducer(spark, d):
    from cohortlens.functions import scalars

    rows = t.table(spark, d, "part").groupBy(F.col("p_brand").alias("run"), "p_type").agg(F.avg("p_size").alias("s"))
    rows = rows.withColumn("passed", F.when(F.col("s") <= 30, F.col("s") > 18))
    return rows.groupBy("run").agg(scalars.status_of(~F.col("passed"), F.col("passed")).alias("status"))


@query("v16_fixed_scores_flipped_labels", f"""WITH {S.predictions()}, fl AS (SELECT label AS old, participant, pair_id, score, CAST(xor(label, {S.hash_long("'21'", "pair_id")} % 2) AS INTEGER) AS label FROM subjects),
{rank_sql('fl')} SELECT n, n_pos, round(auc, 9) AS auc, round(ap, 9) AS ap FROM rank_out""")
def fixed_scores(spark, d):
    from cohortlens.operators import pairing

    flipped = pairing.flip_by_pair(subjects(spark, d, (1,)), 21)
    return ranking.ranking(flipped, []).select("n", "n_pos", F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"))
