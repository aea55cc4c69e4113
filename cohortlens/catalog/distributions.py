"""Distribution summaries and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import gates, normalize, scale, summaries
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t

VALUES = """i AS (SELECT l_suppkey AS case_id, l_linestatus AS modality, l_returnflag AS cohort, l_extendedprice AS v, l_quantity AS q, l_discount AS d FROM lineitem)"""


def r(digits, *names):
    return [F.round(c, digits).alias(c) for c in names]


def rsql(digits, *pairs):
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in pairs)


PCT = [("p01", .01), ("p05", .05), ("p25", .25), ("median", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99)]
PCT_SQL = rsql(6, *[(n, f"quantile_cont(v, {p})") for n, p in PCT])


@query("d1_distribution_summary", f"""WITH {VALUES} SELECT case_id, modality, count(*) AS count, {rsql(6, ('mean', 'avg(v)'), ('std', 'stddev_pop(v)'))}, min(v) AS min, max(v) AS max, {PCT_SQL} FROM i GROUP BY case_id, modality""")
def distribution_summary(spark, d):
    out = summaries.distribution_summary(t.intensities(spark, d), ["case_id", "modality"], "v")
    return out.select("case_id", "modality", "count", "min", "max", *r(6, "mean", "std", *[n for n, _ in PCT]))


@query("d2_small_summary", f"""WITH {VALUES}, x AS (SELECT case_id, CASE WHEN case_id % 10 <> 0 AND d > 0.05 THEN v END AS v FROM i)
SELECT case_id, count(v) AS count, {rsql(6, ('mean', 'avg(v)'), ('median', 'median(v)'), ('std', 'stddev_pop(v)'))}, min(v) AS min, max(v) AS max FROM x GROUP BY case_id""")
def small_summary(spark, d):
    df = t.intensities(spark, d)
    df = df.select("case_id", F.when((F.col("case_id") % 10 != 0) & (F.col("d") > 0.05), F.col("v")).alias("v"))
    return summaries.small_summary(df, ["case_id"], "v").select("case_id", "count", "min", "max", *r(6, "mean", "median", "std"))


@query("d3_location_mean_variance", f"""WITH {S.PIXELS} SELECT channel, y, x, count(*) AS n, {rsql(9, ('mean', 'avg(v::DOUBLE)'), ('std', 'stddev_pop(v::DOUBLE)'))} FROM pixels GROUP BY channel, y, x""")
def location_variance(spark, d):
    v = F.col("v").cast("double")
    out = t.pixels(spark, d).groupBy("channel", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return out.select("channel", "y", "x", "n", *r(9, "mean", "std"))


@query("d4_moments", f"""WITH {VALUES}, m AS (SELECT case_id, avg(v) AS mu FROM i GROUP BY case_id),
c AS (SELECT case_id, any_value(mu) AS mean, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM i JOIN m USING (case_id) GROUP BY case_id)
SELECT case_id, {rsql(6, ('mean', 'mean'), ('std', 'sqrt(m2)'), ('skewness', 'm3 / pow(m2, 1.5)'), ('kurtosis', 'm4 / (m2 * m2)'))} FROM c""")
def moments(spark, d):
    return summaries.moments(t.intensities(spark, d), ["case_id"], "v").select("case_id", *r(6, "mean", "std", "skewness", "kurtosis"))


CV = f"""{S.PIXELS}, cv AS (SELECT channel, y, x, stddev_pop(abs(v::DOUBLE)) / (avg(abs(v::DOUBLE)) + 1e-8) AS cv FROM pixels GROUP BY channel, y, x)"""


@query("d5_variation", f"""WITH {CV} SELECT channel, {rsql(8, ('mean', 'avg(cv)'), ('median', 'median(cv)'), ('below_1e6', '100.0 * avg(CAST(cv < 1e-6 AS INTEGER))'), ('below_half', '100.0 * avg(CAST(cv < 0.7 AS INTEGER))'))} FROM cv GROUP BY channel""")
def variation(spark, d):
    px = t.pixels(spark, d).withColumn("v", F.abs(F.col("v").cast("double")))
    cv = summaries.variation(px, ["channel", "y", "x"], "v")
    # 64 locations per channel.
    return cv.groupBy("channel").agg(
        F.round(F.avg("cv"), 8).alias("mean"), F.round(F.median("cv"), 8).alias("median"),
        F.round(summaries.share_below("cv", 1e-6), 8).alias("below_1e6"), F.round(summaries.share_below("cv", 0.7), 8).alias("below_half"),
    )


@query("d6_channel_correlations", f"""WITH {VALUES} SELECT case_id, 'v' AS a, 'q' AS b, round(corr(v, q), 9) AS r FROM i GROUP BY case_id UNION ALL
SELECT case_id, 'v', 'd', round(corr(v, d), 9) FROM i GROUP BY case_id UNION ALL SELECT case_id, 'q', 'd', round(corr(q, d), 9) FROM i GROUP BY case_id""")
def channel_correlations(spark, d):
    out = summaries.channel_correlations(t.intensities(spark, d), ["case_id"], ["v", "q", "d"])
    return out.withColumn("r", F.round("r", 9))


@query("d7_pairwise_cosine", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.label AS channel, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c
  FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT channel, count(*) AS pairs, round(avg(c), 9) AS mean, round(stddev_pop(c), 8) AS std FROM p GROUP BY channel""")
def pairwise_cosine(spark, d):
    out = summaries.pairwise_cosine(t.slices(spark, d), ["channel"], "px")
    return out.select("channel", "pairs", F.round("mean", 9).alias("mean"), F.round("std", 8).alias("std"))


COSINE_LEVELS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("d7_cosine_percentiles", f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.label AS channel, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT channel, count(*) AS pairs, {rsql(8, *[(n, f'quantile_cont(c, {p})') for n, p in COSINE_LEVELS.items()])} FROM p GROUP BY channel""")
def cosine_percentiles(spark, d):
    out = summaries.pairwise_cosine_quantiles(t.slices(spark, d), ["channel"], "slice_id", "px", COSINE_LEVELS)
    return out.select("channel", "pairs", *r(8, *COSINE_LEVELS))


@query("d8_shared_histogram", f"""WITH {VALUES}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM i),
h AS (SELECT cohort, CAST(least(39, floor((v - lo) / (hi - lo) * 40)) AS INTEGER) AS bin, count(*) AS count FROM i, b GROUP BY ALL)
SELECT *, CAST(sum(count) OVER (PARTITION BY cohort) AS BIGINT) AS total FROM h""")
def shared_histogram(spark, d):
    return summaries.shared_histogram(t.intensities(spark, d), "cohort", "v", 40)


@query("d9_method_comparison", f"""WITH {VALUES}, c AS (SELECT modality, CAST(floor(v / 1000) AS INTEGER) AS bin, stddev_pop(q) / (avg(q) + 1e-8) AS cv FROM i GROUP BY ALL),
j AS (SELECT a.bin, a.cv AS a, b.cv AS b FROM c a JOIN c b ON a.bin = b.bin AND a.modality = 'F' AND b.modality = 'O')
SELECT count(*) AS common_bins, {rsql(8, ('median_a', 'median(a)'), ('median_b', 'median(b)'), ('ratio', 'median(a) / greatest(median(b), 1e-8)'), ('percent_b_lower', '100.0 * avg(CAST(b < a AS INTEGER))'))},
 CASE WHEN count(*) = 0 THEN 'INCONCLUSIVE' WHEN median(a) < median(b) THEN 'a' WHEN median(b) < median(a) THEN 'b' ELSE 'equal' END AS lower_variation FROM j""")
def method_comparison(spark, d):
    df = t.intensities(spark, d).withColumn("bin", F.floor(F.col("v") / 1000).cast("int"))
    cv = staged(summaries.variation(df, ["modality", "bin"], "q"))
    both = cv.where("modality = 'F'").select("bin", F.col("cv").alias("a")).join(cv.where("modality = 'O'").select("bin", F.col("cv").alias("b")), "bin")
    # One row per frequency bin.
    ma, mb = F.median("a"), F.median("b")
    return both.agg(
        F.count(F.lit(1)).alias("common_bins"), F.round(ma, 8).alias("median_a"), F.round(mb, 8).alias("median_b"),
        F.round(ma / F.greatest(mb, F.lit(1e-8)), 8).alias("ratio"),
        F.round(100.0 * F.avg((F.col("b") < F.col("a")).cast("int")), 8).alias("percent_b_lower"),
        F.when(F.count(F.lit(1)) == 0, "INCONCLUSIVE").when(ma < mb, "a").when(mb < ma, "b").otherwise("equal").alias("lower_variation"),
    )


DICE = """dc AS (SELECT l_suppkey AS case_id, l_linestatus AS model, l_linenumber AS z, 2.0::DOUBLE * sum(CASE WHEN l_discount > 0.05 AND l_returnflag = 'R' THEN 1 ELSE 0 END)
 / greatest(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 1) AS dice FROM lineitem GROUP BY ALL)"""


def dice_rows(spark, d):
    hit, real = F.col("l_discount") > 0.05, F.col("l_returnflag") == "R"
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("case_id"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("z")
    ).agg((2.0 * one(hit & real) / F.greatest(one(hit) + one(real), F.lit(1))).alias("dice"))


@query("d10_unit_histogram", f"""WITH {DICE} SELECT model, CAST(least(9, floor(dice * 10)) AS INTEGER) AS bin, count(*) AS count FROM dc GROUP BY ALL""")
def unit_histogram(spark, d):
    return summaries.unit_histogram(dice_rows(spark, d), ["model"], "dice")


@query("d11_nearest_to_midpoint", f"""WITH {DICE}, k AS (SELECT case_id * 100 + z * 10 + CASE WHEN model = 'F' THEN 1 ELSE 0 END AS uid, round(dice, 9) AS dice FROM dc), b AS (SELECT *, CAST(least(9, floor(dice * 10)) AS INTEGER) AS bin FROM k)
SELECT bin, uid, dice, CAST(row_number() OVER (PARTITION BY bin ORDER BY round(abs(dice - (bin + 0.5) / 10), 12), dice DESC, uid) AS INTEGER) AS pick FROM b QUALIFY pick <= 3""")
def nearest_to_midpoint(spark, d):
    uid = F.col("case_id") * 100 + F.col("z") * 10 + F.when(F.col("model") == "F", 1).otherwise(0)
    rows = dice_rows(spark, d).select(uid.alias("uid"), F.round("dice", 9).alias("dice"))
    return summaries.nearest_to_midpoints(rows, "dice", "uid", 3).select("bin", "uid", "dice", "pick")


@query("d12_value_fractions", f"""WITH {VALUES}, f AS (SELECT case_id, modality, avg(CAST(d - 0.02 < 0 AS INTEGER)) AS below, avg(CAST(q > 40 AS INTEGER)) AS above, avg(CAST(d = 0 AS INTEGER)) AS zero FROM i GROUP BY ALL)
SELECT modality, {rsql(9, ('below_mean', 'avg(below)'), ('below_max', 'max(below)'), ('above_mean', 'avg(above)'), ('above_min', 'min(above)'), ('zero_mean', 'avg(zero)'), ('zero_max', 'max(zero)'))} FROM f GROUP BY modality""")
def value_fractions(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    f = t.intensities(spark, d).groupBy("case_id", "modality").agg(
        share(F.col("d") - 0.02 < 0).alias("below"), share(F.col("q") > 40).alias("above"), share(F.col("d") == 0).alias("zero"))
    return f.groupBy("modality").agg(*[F.round(fn(c), 9).alias(f"{c}_{n}") for c, n, fn in (
        ("below", "mean", F.avg), ("below", "max", F.max), ("above", "mean", F.avg), ("above", "min", F.min), ("zero", "mean", F.avg), ("zero", "max", F.max))])


@query("d13_case_balanced_means", f"""WITH {VALUES}, c AS (SELECT case_id, cohort, modality, avg(v) AS v, avg(q) AS q FROM i GROUP BY ALL)
SELECT cohort, modality, count(*) AS cases, round(avg(v), 6) AS v, round(avg(q), 6) AS q FROM c GROUP BY cohort, modality""")
def case_balanced(spark, d):
    return summaries.two_level_mean(t.intensities(spark, d), ["case_id"], ["cohort", "modality"], ["v", "q"]).select("cohort", "modality", "cases", *r(6, "v", "q"))


SCALED = f"""{VALUES}, sc AS (SELECT case_id, modality, d * q / 2 AS x, CAST(q AS INTEGER) * 3 AS z FROM i)"""


def scaled_values(spark, d):
    """Values around 1 with a depth from 3 to 150."""
    return t.intensities(spark, d).select("case_id", "modality", (F.col("d") * F.col("q") / 2).alias("x"), (F.col("q").cast("int") * 3).alias("z"))


@query("d14_foreground_statistics", f"""WITH {SCALED} SELECT case_id, {rsql(9, ('positive', 'avg(CAST(x > 0 AS INTEGER))'), ('above_002', 'avg(CAST(x > 0.02 AS INTEGER))'), ('above_one', 'avg(CAST(x > 1 AS INTEGER))'), ('positive_mean', 'avg(x) FILTER (WHERE x > 0)'),
 *[(n, f'quantile_cont(x, {p}) FILTER (WHERE x > 0)') for n, p in (('p10', 0.1), ('p50', 0.5), ('p90', 0.9), ('p99', 0.99))])} FROM sc GROUP BY case_id""")
def foreground_statistics(spark, d):
    out = summaries.foreground_statistics(scaled_values(spark, d), ["case_id"], "x")
    return out.select("case_id", *r(9, "positive", "above_002", "above_one", "positive_mean", "p10", "p50", "p90", "p99"))


@query("d14_depth_histogram", f"""WITH {SCALED} SELECT case_id, modality, count(*) AS n, round(avg(CAST(z >= 50 AND z < 100 AS INTEGER)), 9) AS inner_share, [{', '.join(f'count(*) FILTER (WHERE z = {z})' for z in range(155))}] AS histogram FROM sc GROUP BY ALL""")
def depth_histogram(spark, d):
    out = summaries.depth_histogram(scaled_values(spark, d), ["case_id", "modality"], "z")
    return out.withColumn("inner_share", F.round("inner_share", 9))


@query("d15_tissue_inclusion", f"""WITH {VALUES}, m AS (SELECT case_id, modality, avg(v) AS full_mean, avg(v) FILTER (WHERE d > 0) AS fg_mean FROM i GROUP BY ALL)
SELECT case_id, modality, count(*) FILTER (WHERE d > 0 AND v >= full_mean) AS selected_full, count(*) FILTER (WHERE d > 0 AND v >= fg_mean) AS selected_fg,
 count(*) FILTER (WHERE d >= 0.09 AND v >= full_mean) AS core_full, count(*) FILTER (WHERE d > 0 AND d < 0.09 AND v >= full_mean) AS boundary_full, count(*) FILTER (WHERE d = 0 AND v >= full_mean) AS background_full
FROM i JOIN m USING (case_id, modality) GROUP BY case_id, modality""")
def tissue_inclusion(spark, d):
    df = t.intensities(spark, d)
    fg, core = F.col("d") > 0, F.col("d") >= 0.09
    means = df.groupBy("case_id", "modality").agg(F.avg("v").alias("full_mean"), F.avg(F.when(fg, F.col("v"))).alias("fg_mean"))
    gate, gate_fg = F.col("v") >= F.col("full_mean"), F.col("v") >= F.col("fg_mean")
    return scale.attach(df, means, ["case_id", "modality"]).groupBy("case_id", "modality").agg(
        F.count_if(fg & gate).alias("selected_full"), F.count_if(fg & gate_fg).alias("selected_fg"), F.count_if(core & gate).alias("core_full"),
        F.count_if(fg & ~core & gate).alias("boundary_full"), F.count_if(~fg & gate).alias("background_full"))


@query("d16_mutual_information", f"""WITH {VALUES}, g AS (SELECT modality, min(v) AS v0, max(v) AS v1, min(q) AS q0, max(q) AS q1, count(*) AS n FROM i GROUP BY modality),
h AS (SELECT modality, n, CAST(least(63, floor((v - v0) / (v1 - v0) * 64)) AS INTEGER) AS a, CAST(least(63, floor((q - q0) / (q1 - q0) * 64)) AS INTEGER) AS b, count(*) AS c FROM i JOIN g USING (modality) GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY modality, a) AS ca, sum(c) OVER (PARTITION BY modality, b) AS cb FROM h)
SELECT modality, any_value(n) AS n, round(sum(c / n * ln(c::DOUBLE * n / (ca::DOUBLE * cb))), 9) AS mutual_information FROM m GROUP BY modality""")
def mutual_information(spark, d):
    return summaries.mutual_information(t.intensities(spark, d), ["modality"], "v", "q").withColumn("mutual_information", F.round("mutual_information", 9))


PROFILE = """pr AS (SELECT l_returnflag AS cohort, CAST(least(63, floor(l_extendedprice / 1700)) AS INTEGER) AS bin, sum(l_quantity) AS mass FROM lineitem GROUP BY ALL),
ref AS (SELECT bin, sum(mass) AS mass FROM pr WHERE cohort = 'R' GROUP BY bin)"""


def profiles(spark, d):
    bin_col = F.least(F.lit(63), F.floor(F.col("l_extendedprice") / 1700)).cast("int").alias("bin")
    return t.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cohort"), bin_col).agg(F.sum("l_quantity").alias("mass"), F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("level"))


@query("d17_profile_divergence", f"""WITH {PROFILE}, p AS (SELECT cohort, bin, mass / sum(mass) OVER (PARTITION BY cohort) AS p FROM pr), q AS (SELECT bin, mass / sum(mass) OVER () AS q FROM ref),
j AS (SELECT cohort, p, q, (p + q) / 2 AS m, (bin + 0.5::DOUBLE) * sqrt(0.5::DOUBLE) / 64 AS f FROM p JOIN q USING (bin))
SELECT cohort, {rsql(8, ('js_bits', '0.5 * sum(p * log2(greatest(p, 1e-30) / greatest(m, 1e-30))) + 0.5 * sum(q * log2(greatest(q, 1e-30) / greatest(m, 1e-30)))'), ('cosine', 'sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))'),
 ('centroid', 'sum(p * f)'), ('low_share', 'coalesce(sum(p) FILTER (WHERE f <= 0.1), 0)'), ('high_share', 'coalesce(sum(p) FILTER (WHERE f >= 0.25), 0)'))} FROM j GROUP BY cohort""")
def profile_divergence(spark, d):
    pr = profiles(spark, d)
    frequency = (F.col("bin") + 0.5) * (0.5 ** 0.5) / 64
    out = summaries.profile_divergence(pr, ["cohort"], "bin", "mass", pr.where("cohort = 'R'"), frequency)
    return out.select("cohort", *r(8, "js_bits", "cosine", "centroid", "low_share", "high_share"))


@query("d18_mixture_check", """WITH b AS (SELECT CAST(least(63, floor(l_extendedprice / 1700)) AS INTEGER) AS bin, round(avg(l_quantity), 8) AS v FROM lineitem GROUP BY 1)
SELECT bin, v AS expected, round(CASE WHEN bin % 13 = 0 THEN v + 0.001 ELSE v END, 8) AS observed, abs(CASE WHEN bin % 13 = 0 THEN v + 0.001 ELSE v END - v) <= 2e-6 AS ok FROM b""")
def mixture_check(spark, d):
    bin_col = F.least(F.lit(63), F.floor(F.col("l_extendedprice") / 1700)).cast("int").alias("bin")
    mixed = t.table(spark, d, "lineitem").groupBy(bin_col).agg(F.avg("l_quantity").alias("level"))
    # Some bins are shifted, and the check has to find them.
    mixed = mixed.withColumn("level", F.when(F.col("bin") % 13 == 0, F.col("level") + 0.001).otherwise(F.col("level")))
    out = summaries.weighted_mixture_check(profiles(spark, d), mixed, "bin", "level", "n", 2e-6)
    return out.select("bin", F.round("expected", 8).alias("expected"), F.round("observed", 8).alias("observed"), "ok")


VARIANTS = """va AS (SELECT l_suppkey AS case_id, l_linestatus AS modality, l_extendedprice / 1000 AS a, l_extendedprice * (1 - l_discount) / 1000 AS b FROM lineitem)"""


def variants(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linestatus").alias("modality"), (F.col("l_extendedprice") / 1000).alias("a"),
                                                (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("b"))


QUANT = {f"q{i:02d}": i / 10 for i in range(1, 10)}


@query("d19_paired_normalization", f"""WITH {VARIANTS} SELECT case_id, modality, count(*) AS n, {rsql(7, ('mae', 'avg(abs(b - a))'), ('rmse', 'sqrt(avg((b - a) * (b - a)))'), ('bias', 'avg(b - a)'),
 ('quantile_mae', '(' + ' + '.join(f'abs(quantile_cont(b, {p}) - quantile_cont(a, {p}))' for p in QUANT.values()) + ') / 9'), ('mean_a', 'avg(a)'), ('mean_b', 'avg(b)'), ('std_a', 'stddev_pop(a)'), ('std_b', 'stddev_pop(b)'))} FROM va GROUP BY case_id, modality""")
def paired_normalization(spark, d):
    keys = ["case_id", "modality"]
    df = variants(spark, d)
    base = summaries.paired_difference(df, keys, "a", "b")
    qa = scale.exact_quantiles(df, keys, "a", {f"a{n}": p for n, p in QUANT.items()})
    qb = scale.exact_quantiles(df, keys, "b", {f"b{n}": p for n, p in QUANT.items()})
    gap = sum((F.abs(F.col(f"b{n}") - F.col(f"a{n}")) for n in QUANT), F.lit(0.0)) / len(QUANT)
    out = base.join(qa, keys).join(qb, keys).withColumn("quantile_mae", gap)
    return out.select(*keys, "n", *r(7, "mae", "rmse", "bias", "quantile_mae", "mean_a", "mean_b", "std_a", "std_b"))


@query("d20_stage_timing", f"""SELECT event_type AS stage, count(*) AS count, {rsql(7, ('mean', 'avg(value)'), ('total', 'sum(value)'), ('median', 'median(value)'))}, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def stage_timing(spark, d):
    return summaries.stage_timing(t.timings(spark, d), "stage", "seconds").select("stage", "count", *r(7, "mean", "total", "median"), "p95")


@query("d20_timing_overview", f"""WITH tm AS (SELECT event_type AS run, CASE WHEN event_id % 11 <> 0 THEN user_id END AS subject, value AS seconds, user_id % 5 = 0 AS hit FROM events),
rw AS (SELECT event_type AS run, count(*) * 150.0::DOUBLE AS wall FROM events GROUP BY 1), pr AS (SELECT run, subject, round(sum(seconds), 6) AS s, bool_or(hit) AS hit FROM tm GROUP BY ALL)
SELECT run, wall, count(*) FILTER (WHERE subject IS NOT NULL AND NOT hit) AS inferred, count(*) FILTER (WHERE subject IS NOT NULL AND hit) AS cache_hits, {rsql(4, ('stage_seconds', 'sum(s)'), ('shared_seconds', 'coalesce(sum(s) FILTER (WHERE subject IS NULL), 0)'), ('overhead_seconds', 'wall - sum(s)'),
 ('subject_mean', 'avg(s) FILTER (WHERE subject IS NOT NULL)'), ('subject_median', 'median(s) FILTER (WHERE subject IS NOT NULL)'), ('subject_p95', 'quantile_disc(s, 0.95) FILTER (WHERE subject IS NOT NULL)'))} FROM pr JOIN rw USING (run) GROUP BY run, wall""")
def timing_overview(spark, d):
    events = t.table(spark, d, "events")
    subject = F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("subject")
    timings = events.select(F.col("event_type").alias("run"), subject, F.col("value").alias("seconds"), (F.col("user_id") % 5 == 0).alias("hit"))
    walls = events.groupBy(F.col("event_type").alias("run")).agg((F.count(F.lit(1)) * 150.0).alias("wall"))
    out = summaries.timing_overview(timings, walls, ["run"], "subject", "seconds", "hit", "wall")
    return out.select("run", "wall", "inferred", "cache_hits", *r(4, "stage_seconds", "shared_seconds", "overhead_seconds", "subject_mean", "subject_median", "subject_p95"))


CURVE = """cu AS (SELECT o_orderpriority AS run, CAST(date_diff('month', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS epoch, avg(o_totalprice) / 1000 AS train, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / 1000 AS val FROM orders GROUP BY ALL)"""


def curves(spark, d):
    epoch = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).cast("int").alias("epoch")
    return t.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run"), epoch).agg(
        (F.avg("o_totalprice") / 1000).alias("train"), (F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 1000).alias("val"))


@query("d21_learning_curve", f"""WITH {CURVE}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS k FROM cu WHERE val IS NOT NULL),
a AS (SELECT run, arg_max(train, epoch) AS ft, arg_max(val, epoch) AS fv, min(val) AS bv, arg_min(epoch, (val, epoch)) FILTER (WHERE val IS NOT NULL) AS best_epoch, avg(val) FILTER (WHERE k <= 20) AS lm, avg(val) FILTER (WHERE k > 20 AND k <= 40) AS pm FROM k GROUP BY run)
SELECT run, best_epoch, {rsql(6, ('final_train', 'ft'), ('final_validation', 'fv'), ('best_validation', 'bv'), ('last_mean', 'lm'), ('previous_mean', 'pm'), ('reduction_percent', '100.0 * (pm - lm) / pm'))} FROM a""")
def learning_curve(spark, d):
    out = summaries.learning_curve(curves(spark, d).where("val IS NOT NULL"), ["run"], "epoch", "train", "val")
    return out.select("run", "best_epoch", *r(6, "final_train", "final_validation", "best_validation", "last_mean", "previous_mean", "reduction_percent"))


@query("d22_inventory", f"""WITH {S.RECORDS}, g AS (SELECT site, stage, count(*) AS records, count(DISTINCT participant) AS participants, count(DISTINCT source) AS sources FROM records GROUP BY ROLLUP (site, stage))
SELECT *, sources = 5 AS all_sources FROM g""")
def inventory(spark, d):
    rows = t.records(spark, d).rollup("site", "stage").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("participant").alias("participants"), F.countDistinct("source").alias("sources"))
    return rows.withColumn("all_sources", F.col("sources") == 5)


@query("d23_composition", f"""WITH {S.SPLITS} SELECT domain, split, count(*) AS eligible, count(*) FILTER (WHERE support >= 0.5) AS selected FROM records JOIN split_map USING (participant) GROUP BY domain, split""")
def composition(spark, d):
    mapped = t.split_records(spark, d)
    return mapped.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("support") >= 0.5).alias("selected"))


@query("d24_provenance", f"""WITH {S.RECORDS} SELECT site, count(*) AS rows, count(DISTINCT participant) AS subjects, count(DISTINCT case_id) AS sessions FROM records GROUP BY site""")
def provenance(spark, d):
    # Distinct counts in two steps: each key's distinct values are spread over the cluster.
    per = t.records(spark, d).groupBy("site", "participant", "case_id").agg(F.count(F.lit(1)).alias("n"))
    people = per.groupBy("site", "participant").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    return people.groupBy("site").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("subjects"), F.sum("c").alias("sessions"))


@query("d25_matched_levels", f"""WITH {VALUES} SELECT case_id, {rsql(8, ('positive_mean', 'avg(d) FILTER (WHERE d > 0)'), ('mean_above_002', 'avg(d) FILTER (WHERE d > 0.02)'), ('positive_fraction', 'avg(CAST(d > 0 AS INTEGER))'),
 ('p99_ratio', "quantile_cont(v, 0.99) / quantile_cont(v, 0.99) FILTER (WHERE cohort <> 'R')"))} FROM i GROUP BY case_id""")
def matched_levels(spark, d):
    df = t.intensities(spark, d)
    base = df.groupBy("case_id").agg(F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("positive_mean"), F.avg(F.when(F.col("d") > 0.02, F.col("d"))).alias("mean_above_002"), F.avg((F.col("d") > 0).cast("int")).alias("positive_fraction"))
    whole = scale.exact_quantiles(df, ["case_id"], "v", {"all": .99})
    clear = scale.exact_quantiles(df.where("cohort <> 'R'"), ["case_id"], "v", {"clear": .99})
    out = base.join(whole, "case_id").join(clear, "case_id", "left").withColumn("p99_ratio", F.col("all") / F.col("clear"))
    return out.select("case_id", *r(8, "positive_mean", "mean_above_002", "positive_fraction", "p99_ratio"))


LEVELS = (30, 45, 60, 75, 90, 105, 120)
PER_LEVEL = 12


@query("d25_level_sample", f"""WITH lv AS (SELECT l_linestatus AS modality, CAST(l_quantity AS INTEGER) * 3 AS z, l_discount AS d, row_number() OVER (PARTITION BY l_linestatus, CAST(l_quantity AS INTEGER) ORDER BY md5('25|' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber) AS k FROM lineitem)
SELECT modality, z, count(*) AS n, {rsql(9, ('positive_mean', 'avg(d) FILTER (WHERE d > 0)'), ('mean_above_002', 'avg(d) FILTER (WHERE d > 0.02)'), ('positive_fraction', 'avg(CAST(d > 0 AS INTEGER))'))} FROM lv WHERE k <= {PER_LEVEL} AND z IN {LEVELS} GROUP BY modality, z""")
def level_sample(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linestatus").alias("modality"), (F.col("l_quantity").cast("int") * 3).alias("z"), F.col("l_discount").alias("d"))
    chosen = summaries.level_sample(rows, ["modality"], "z", LEVELS, PER_LEVEL, "id", 25)
    v = F.col("d")
    out = chosen.groupBy("modality", "z").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(v > 0, v)).alias("positive_mean"), F.avg(F.when(v > 0.02, v)).alias("mean_above_002"), F.avg((v > 0).cast("int")).alias("positive_fraction"))
    return out.select("modality", "z", "n", *r(9, "positive_mean", "mean_above_002", "positive_fraction"))


@query("d25_ratio_summary", f"""WITH {VALUES}, c AS (SELECT case_id, modality, quantile_cont(v, 0.99) / quantile_cont(v, 0.99) FILTER (WHERE cohort <> 'R') AS ratio FROM i GROUP BY ALL)
SELECT modality, count(ratio) AS cases, {rsql(9, ('median', 'median(ratio)'), ('min', 'min(ratio)'), ('max', 'max(ratio)'))} FROM c GROUP BY modality""")
def ratio_summary(spark, d):
    ratios = staged(summaries.quantile_ratio(t.intensities(spark, d), ["case_id", "modality"], "v", F.col("cohort") != "R", 0.99, "ratio"))
    ends = ratios.groupBy("modality").agg(F.count("ratio").alias("cases"), F.min("ratio").alias("min"), F.max("ratio").alias("max"))
    return ends.join(scale.exact_quantiles(ratios, ["modality"], "ratio", {"median": 0.5}), "modality", "left").select("modality", "cases", *r(9, "median", "min", "max"))


CURVE_STEPS = 100
CURVE_LIST = f"[{', '.join(str(j / CURVE_STEPS) for j in range(CURVE_STEPS + 1))}]"


@query("d26_variant_comparison", f"""WITH {VARIANTS}, c AS (SELECT case_id, avg(abs(b - a)) AS mae, sqrt(avg((b - a) * (b - a))) AS rmse, corr(a, b) AS r, quantile_cont(abs(b - a), 0.95) AS p95 FROM va GROUP BY case_id),
tg AS (SELECT i, avg(q) AS q FROM (SELECT unnest(range({CURVE_STEPS + 1})) AS i, unnest(quantile_cont(a, {CURVE_LIST})) AS q FROM va WHERE modality = 'F' GROUP BY case_id) GROUP BY i),
cv AS (SELECT case_id, unnest(range({CURVE_STEPS + 1})) AS i, unnest(quantile_cont(a, {CURVE_LIST})) AS qa, unnest(quantile_cont(b, {CURVE_LIST})) AS qb FROM va GROUP BY case_id),
er AS (SELECT case_id, avg(abs(qa - q)) AS ea, avg(abs(qb - q)) AS eb FROM cv JOIN tg USING (i) GROUP BY case_id)
SELECT case_id, {rsql(8, ('mae', 'mae'), ('rmse', 'rmse'), ('correlation', 'r'), ('p95', 'p95'))}, {rsql(6, ('a_curve_error', 'ea'), ('b_curve_error', 'eb'))}, case_id = (SELECT arg_max(case_id, mae) FROM c) AS worst FROM c JOIN er USING (case_id)""")
def variant_comparison(spark, d):
    df = variants(spark, d)
    base = summaries.paired_difference(df, ["case_id"], "a", "b")
    q = scale.exact_quantiles(df.select("case_id", F.abs(F.col("b") - F.col("a")).alias("g")), ["case_id"], "g", {"p95": .95})
    target = staged(normalize.reference_curve(df.where("modality = 'F'"), ["case_id"], [], "a", CURVE_STEPS))
    errors = [summaries.quantile_error(df, ["case_id"], v, target, CURVE_STEPS, f"{v}_curve_error") for v in ("a", "b")]
    rows = staged(base.join(q, "case_id").join(errors[0], "case_id").join(errors[1], "case_id"))
    worst = rows.agg(F.max_by("case_id", "mae").alias("_w"))
    out = scale.attach_scalar(rows, worst).withColumn("worst", F.col("case_id") == F.col("_w"))
    return out.select("case_id", *r(8, "mae", "rmse", "correlation", "p95"), *r(6, "a_curve_error", "b_curve_error"), "worst")


@query("d27_grouped_score_summary", f"""WITH {S.RECORDS}, x AS (SELECT source, support >= 0.5 AS gate, {S.probability("'1'")} AS p FROM records), y AS (SELECT *, CASE WHEN p >= 0.5 THEN 'lesion-like' ELSE 'healthy-like' END AS predicted FROM x)
SELECT source, gate, predicted, count(*) AS n, round(avg(p), 9) AS mean, min(p) AS min, max(p) AS max FROM y GROUP BY GROUPING SETS ((), (source), (gate), (predicted), (gate, predicted))""")
def grouped_scores(spark, d):
    rows = t.records(spark, d).select("source", (F.col("support") >= 0.5).alias("gate"), t.probability("1", "record_id", F.col("label")).alias("p"))
    rows = rows.withColumn("predicted", F.when(F.col("p") >= 0.5, "lesion-like").otherwise("healthy-like"))
    sets = [[], [F.col("source")], [F.col("gate")], [F.col("predicted")], [F.col("gate"), F.col("predicted")]]
    return rows.groupingSets(sets, "source", "gate", "predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"))


@query("d28_checkpoint_trend", f"""WITH {CURVE}, y AS (SELECT run, epoch // 12 AS epoch, avg(train) AS a, avg(val) AS b FROM cu GROUP BY ALL),
l AS (SELECT *, a - lag(a) OVER (PARTITION BY run ORDER BY epoch) AS a_delta, b - lag(b) OVER (PARTITION BY run ORDER BY epoch) AS b_delta FROM y)
SELECT run, CAST(epoch AS INTEGER) AS epoch, round(a_delta, 6) AS a_delta, round(b_delta, 6) AS b_delta, CASE WHEN a_delta IS NULL THEN 'BASELINE' WHEN a_delta >= -1 AND b_delta >= -1 THEN 'PASS' WHEN a_delta >= -1 OR b_delta >= -1 THEN 'PARTIAL_PASS' ELSE 'FAIL' END AS status FROM l""")
def checkpoint_trend(spark, d):
    yearly = curves(spark, d).groupBy("run", F.floor(F.col("epoch") / 12).cast("int").alias("epoch")).agg(F.avg("train").alias("a"), F.avg("val").alias("b"))
    return gates.trend(yearly, ["run"], "epoch", ["a", "b"], 1.0).select("run", "epoch", *r(6, "a_delta", "b_delta"), "status")


@query("d29_participant_roster", f"""WITH {S.PAIRS} SELECT split, participant, min(label) AS label, count(*) AS slices, list_sort(list(DISTINCT domain)) AS domains, list_sort(list(DISTINCT pair_id)) AS pairs, list_sort(list(DISTINCT z)) AS zs, list_sort(list(DISTINCT z_bin)) AS bins, list_sort(list(DISTINCT case_id)) AS cases, count(DISTINCT label) = 1 AND count(DISTINCT pair_id) = 1 AS consistent
FROM paired GROUP BY split, participant""")
def roster(spark, d):
    # Matched rows only: a participant has at most cap × bins of them, so the lists are bounded.
    lists = {"domains": "domain", "pairs": "pair_id", "zs": "z", "bins": "z_bin", "cases": "case_id"}
    out = t.paired_records(spark, d).groupBy("split", "participant").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("slices"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in lists.items()], F.max("label").alias("_m"))
    return out.withColumn("consistent", (F.col("label") == F.col("_m")) & (F.size("pairs") == 1)).drop("_m")


# --- normalization ----------------------------------------------------------------------------------------------

def profile(df, out, *keys):
    """Whole-table check of a normalized column: count, mean, extremes per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(out), 8).alias("mean"), F.round(F.min(out), 8).alias("lo"), F.round(F.max(out), 8).alias("hi"))


PROFILE_COLS = "count(*) AS n, round(avg(o), 8) AS mean, round(min(o), 8) AS lo, round(max(o), 8) AS hi"


@query("m1_p99_scale", f"""WITH {VALUES}, s AS (SELECT case_id, modality, quantile_cont(d, 0.99) FILTER (WHERE d > 0) AS p FROM i GROUP BY ALL), o AS (SELECT case_id, modality, d / greatest(p, 1e-8) AS o FROM i JOIN s USING (case_id, modality)) SELECT case_id, modality, {PROFILE_COLS} FROM o GROUP BY ALL""")
def p99_scale(spark, d):
    k = ["case_id", "modality"]
    return profile(normalize.p99_scale(t.intensities(spark, d), k, "d", "o"), "o", *k)


@query("m2_robust_iqr", f"""WITH {VALUES}, s AS (SELECT case_id, modality, median(v) FILTER (WHERE d > 0) AS m, quantile_cont(v, 0.75) FILTER (WHERE d > 0) - quantile_cont(v, 0.25) FILTER (WHERE d > 0) AS w FROM i GROUP BY ALL),
o AS (SELECT case_id, modality, CASE WHEN d > 0 THEN (v - m) / w ELSE -1 END AS o, m, w FROM i JOIN s USING (case_id, modality)) SELECT case_id, modality, round(m, 6) AS median, round(w, 6) AS iqr, {PROFILE_COLS} FROM o GROUP BY ALL""")
def robust_iqr(spark, d):
    k = ["case_id", "modality"]
    out = normalize.robust_iqr(t.intensities(spark, d), k, "v", F.col("d") > 0, "o")
    return profile(out.withColumns({"median": F.round("median", 6), "iqr": F.round("iqr", 6)}), "o", *k, "median", "iqr")


@query("m3_mean_std", f"""WITH {VALUES}, s AS (SELECT case_id, modality, avg(v) FILTER (WHERE d > 0) AS m, stddev_pop(v) FILTER (WHERE d > 0) AS w FROM i GROUP BY ALL), o AS (SELECT case_id, modality, CASE WHEN d > 0 THEN (v - m) / w ELSE -1 END AS o FROM i JOIN s USING (case_id, modality)) SELECT case_id, modality, {PROFILE_COLS} FROM o GROUP BY ALL""")
def mean_std(spark, d):
    k = ["case_id", "modality"]
    return profile(normalize.mean_std(t.intensities(spark, d), k, "v", F.col("d") > 0, "o"), "o", *k)


@query("m4_masked_zscore", f"""WITH {VALUES}, s AS (SELECT case_id, avg(v) FILTER (WHERE cohort <> 'R') AS m, stddev_pop(v) FILTER (WHERE cohort <> 'R') AS w FROM i GROUP BY ALL), o AS (SELECT case_id, cohort, CASE WHEN cohort <> 'R' THEN (v - m) / w ELSE 0 END AS o FROM i JOIN s USING (case_id)) SELECT case_id, cohort, {PROFILE_COLS} FROM o GROUP BY ALL""")
def masked_zscore(spark, d):
    return profile(normalize.mean_std(t.intensities(spark, d), ["case_id"], "v", F.col("cohort") != "R", "o", background=0.0), "o", "case_id", "cohort")


@query("m5_p99_clip", f"""WITH {VALUES}, s AS (SELECT case_id, quantile_cont(d, 0.99) FILTER (WHERE d <> 0) AS p FROM i GROUP BY ALL), o AS (SELECT case_id, least(1, greatest(0, d / p)) AS o FROM i JOIN s USING (case_id)) SELECT case_id, {PROFILE_COLS} FROM o GROUP BY ALL""")
def p99_clip(spark, d):
    return profile(normalize.p99_clip(t.intensities(spark, d), ["case_id"], "d", "o"), "o", "case_id")


@query("m6_equalize", f"""WITH {VALUES}, g AS (SELECT modality, max(q - 5) AS top, min(q - 5) FILTER (WHERE q > 5) / max(q - 5) AS lo FROM i GROUP BY modality),
x AS (SELECT modality, q, (q - 5) / top AS v, lo FROM i JOIN g USING (modality)), b AS (SELECT modality, CAST(greatest(0, least(255, floor((v - lo) / (1 - lo) * 256))) AS INTEGER) AS bin, count(*) AS c FROM x WHERE q > 5 GROUP BY ALL),
k AS (SELECT m.modality, k, coalesce(c, 0) AS c FROM (SELECT DISTINCT modality FROM b) m CROSS JOIN range(256) r(k) LEFT JOIN b ON b.modality = m.modality AND b.bin = k),
f AS (SELECT modality, k, sum(c) OVER (PARTITION BY modality ORDER BY k) / sum(c) OVER (PARTITION BY modality) AS f FROM k),
z AS (SELECT modality, q, (v - lo) / ((1 - lo) / 256) - 0.5 AS p FROM x),
o AS (SELECT z.modality, q, CASE WHEN q > 5 THEN a.f + (b.f - a.f) * (p - floor(p)) ELSE 0 END AS o FROM z LEFT JOIN f a ON a.modality = z.modality AND a.k = greatest(0, least(255, floor(p))) LEFT JOIN f b ON b.modality = z.modality AND b.k = greatest(0, least(255, floor(p) + 1)))
SELECT modality, q, {PROFILE_COLS} FROM o GROUP BY ALL""")
def equalize(spark, d):
    df = t.intensities(spark, d).withColumn("w", F.col("q") - 5)
    return profile(normalize.equalize(df, ["modality"], "w", "o"), "o", "modality", "q")


GRID = 4096
# Landmarks of a published curve. Times FINE they are whole hundredths, which round alike everywhere.
FINE = 4096


def land_sql(grid: int) -> str:
    return f"""land AS (SELECT modality, CAST(i AS INTEGER) AS i, q FROM (SELECT modality, unnest(range({grid} + 1)) AS i, unnest(quantile_cont(v, [{', '.join(str(j / grid) for j in range(grid + 1))}])) AS q FROM i GROUP BY modality))"""


LAND = land_sql(GRID)


@query("m7_landmarks", f"WITH {VALUES}, {land_sql(FINE)} SELECT modality, i, round(q * {FINE}, 2) AS scaled FROM land")
def landmarks(spark, d):
    return normalize.landmarks(t.intensities(spark, d), ["modality"], "v", FINE).select("modality", "i", F.round(F.col("q") * FINE, 2).alias("scaled"))


REFERENCE = f"""rc AS (SELECT case_id, CAST(i AS INTEGER) AS i, q FROM (SELECT case_id, unnest(range({GRID} + 1)) AS i, unnest(quantile_cont(v, [{', '.join(str(j / GRID) for j in range(GRID + 1))}])) AS q FROM i WHERE cohort = 'R' GROUP BY case_id)),
target AS (SELECT i, avg(q) AS q FROM rc GROUP BY i)"""


def reference(spark, d):
    return staged(normalize.reference_curve(t.intensities(spark, d).where("cohort = 'R'"), ["case_id"], [], "v", GRID))


@query("m9_reference_curve", f"WITH {VALUES}, {REFERENCE} SELECT i, round(q, 3) AS q FROM target")
def reference_curve(spark, d):
    return reference(spark, d).select("i", F.round("q", 3).alias("q"))


MATCHED = f"""{VALUES}, {LAND}, {REFERENCE}, kn AS (SELECT modality, land.i, land.q AS x, avg(target.q) OVER (PARTITION BY modality, land.q) AS y FROM land JOIN target USING (i)),
dv AS (SELECT modality, v, count(*) AS n FROM i GROUP BY ALL),
br AS (SELECT dv.modality, v, n, max(x) FILTER (WHERE x <= v) AS x0, arg_max(y, x) FILTER (WHERE x <= v) AS y0, min(x) FILTER (WHERE x >= v) AS x1, arg_min(y, x) FILTER (WHERE x >= v) AS y1 FROM dv JOIN kn USING (modality) GROUP BY ALL),
mapped AS (SELECT modality, v, n, CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (v - x0) / (x1 - x0) END AS mapped FROM br)"""


def matched(spark, d):
    return normalize.quantile_map(t.intensities(spark, d), ["modality"], "v", reference(spark, d), intervals=GRID)


@query("m8_apply_map", f"""WITH {MATCHED}, o AS (SELECT case_id, i.modality, mapped AS o FROM i JOIN mapped ON i.modality = mapped.modality AND i.v = mapped.v) SELECT case_id, modality, count(*) AS n, round(avg(o), 4) AS mean, round(min(o), 4) AS lo, round(max(o), 4) AS hi FROM o GROUP BY ALL""")
def apply_map(spark, d):
    out = normalize.apply_map(t.intensities(spark, d), ["modality"], "v", matched(spark, d), "o")
    return out.groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 4).alias("mean"), F.round(F.min("o"), 4).alias("lo"), F.round(F.max("o"), 4).alias("hi"))


@query("m10_quantile_match", f"WITH {MATCHED} SELECT modality, v, n, round(mapped, 3) AS mapped FROM mapped")
def quantile_match(spark, d):
    return matched(spark, d).withColumn("mapped", F.round("mapped", 3))


@query("m11_distribution_distance", f"""WITH {MATCHED}, g AS (SELECT m.modality, t.i, t.q, sum(m.n) FILTER (WHERE m.v <= t.q) / sum(m.n) AS f FROM mapped m CROSS JOIN target t GROUP BY ALL),
e AS (SELECT *, abs(f - i / {GRID}) AS e FROM g), a AS (SELECT *, (e + lag(e) OVER w) / 2 * (q - lag(q) OVER w) AS area FROM e WINDOW w AS (PARTITION BY modality ORDER BY i))
SELECT modality, round(max(e), 8) AS cdf_max_error, round(sum(area) / (max(q) FILTER (WHERE i = {3 * GRID // 4}) - max(q) FILTER (WHERE i = {GRID // 4})), 7) AS wasserstein_over_iqr FROM a GROUP BY modality""".replace("sum(m.n) FILTER (WHERE m.v <= t.q) / sum(m.n)", "coalesce(sum(m.n) FILTER (WHERE m.v <= t.q), 0) / sum(m.n)"))
def distribution_distance(spark, d):
    df = t.intensities(spark, d)
    grid = reference(spark, d).withColumn("modality", F.explode(F.array(F.lit("F"), F.lit("O"))))
    out = normalize.distribution_distance(df, ["modality"], "v", grid, GRID)
    return out.select("modality", F.round("cdf_max_error", 8).alias("cdf_max_error"), F.round("wasserstein_over_iqr", 7).alias("wasserstein_over_iqr"))


TRAIN = """tr AS (SELECT l_suppkey AS case_id, CASE WHEN l_linenumber <= 4 THEN 'train' ELSE 'test' END AS split, l_extendedprice AS a, l_quantity AS b, 1.5::DOUBLE AS c FROM lineitem)"""


def train_rows(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.when(F.col("l_linenumber") <= 4, "train").otherwise("test").alias("split"),
                                                F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"), F.lit(1.5).alias("c"))


@query("m12_train_standardizer", f"""WITH {TRAIN}, s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM tr WHERE split = 'train')
SELECT case_id, split, count(*) AS n, round(avg((a - ma) / sa), 8) AS a, round(avg((b - mb) / sb), 8) AS b, round(avg(c - 1.5), 8) AS c FROM tr, s GROUP BY case_id, split""")
def train_standardizer(spark, d):
    out = normalize.train_standardizer(train_rows(spark, d), ["a", "b", "c"])
    return out.groupBy("case_id", "split").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 8).alias(c) for c in "abc"])


@query("m13_train_scale", f"""WITH {TRAIN} SELECT round(greatest(quantile_cont(abs(a - 50000), 0.995), 1e-6), 6) AS scale FROM tr WHERE split = 'train'""")
def train_scale(spark, d):
    return normalize.train_scale(train_rows(spark, d).withColumn("a", F.col("a") - 50000), "a").select(F.round("scale", 6).alias("scale"))


@query("m14_alignment", f"""WITH {VALUES}, s AS (SELECT case_id, quantile_cont(v, 0.25) AS s1, quantile_cont(v, 0.5) AS s2, quantile_cont(v, 0.75) AS s3 FROM i WHERE modality = 'F' GROUP BY case_id),
g AS (SELECT case_id, quantile_cont(v, 0.25) AS t1, quantile_cont(v, 0.5) AS t2, quantile_cont(v, 0.75) AS t3 FROM i WHERE modality = 'O' GROUP BY case_id),
o AS (SELECT case_id, v + t2 - s2 AS a, (v - s2) * CASE WHEN s3 - s1 <= 1e-8 THEN 1 ELSE (t3 - t1) / (s3 - s1) END + s2 AS b, (v - s2) * CASE WHEN s3 - s1 <= 1e-8 THEN 1 ELSE (t3 - t1) / (s3 - s1) END + t2 AS c FROM i JOIN s USING (case_id) JOIN g USING (case_id) WHERE modality = 'F'),
pt AS (SELECT case_id, x, avg(y) AS y FROM (SELECT case_id, unnest(quantile_cont(v, {CURVE_LIST}) FILTER (WHERE modality = 'F')) AS x, unnest(quantile_cont(v, {CURVE_LIST}) FILTER (WHERE modality = 'O')) AS y FROM i GROUP BY case_id) GROUP BY case_id, x),
br AS (SELECT case_id, v, n, max(x) FILTER (WHERE x <= v) AS x0, arg_max(y, x) FILTER (WHERE x <= v) AS y0, min(x) FILTER (WHERE x >= v) AS x1, arg_min(y, x) FILTER (WHERE x >= v) AS y1
 FROM (SELECT case_id, v, count(*) AS n FROM i WHERE modality = 'F' GROUP BY ALL) JOIN pt USING (case_id) GROUP BY ALL),
mq AS (SELECT case_id, n, CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (v - x0) / (x1 - x0) END AS o FROM br)
SELECT case_id, 'quantile' AS method, round(ln(sum(n * o) / sum(n)), 9) AS log_mean, round(ln(max(o)), 9) AS log_hi FROM mq GROUP BY case_id UNION ALL
SELECT case_id, 'median' AS method, round(ln(avg(a)), 9) AS log_mean, round(ln(max(a)), 9) AS log_hi FROM o GROUP BY case_id UNION ALL SELECT case_id, 'iqr', round(ln(avg(b)), 9), round(ln(max(b)), 9) FROM o GROUP BY case_id UNION ALL SELECT case_id, 'median_iqr', round(ln(avg(c)), 9), round(ln(max(c)), 9) FROM o GROUP BY case_id""")
def alignment(spark, d):
    df = t.intensities(spark, d)
    source, target = df.where("modality = 'F'"), df.where("modality = 'O'")
    methods = ["median", "iqr", "median_iqr", "quantile"]
    long = normalize.align(source, target, ["case_id"], "v", methods).select("case_id", *methods).unpivot("case_id", methods, "method", "o")
    return long.groupBy("case_id", "method").agg(F.round(F.log(F.avg("o")), 9).alias("log_mean"), F.round(F.log(F.max("o")), 9).alias("log_hi"))
