"""Splits, folds, balancing, pairs and label permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.functions import draws
from cohortlens.operators import pairing, splits
from cohortlens.operators.scale import parallelism
from cohortlens.plans import tables as t


def customers(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("site"))


def perm_sql(seed, key="subject_id", part="", src="ids"):
    return f"row_number() OVER ({part} ORDER BY md5('{seed}|' || {key}), {key}) - 1"


IDS = "ids AS (SELECT c_custkey AS subject_id, c_mktsegment AS site FROM customer)"


@query("f4_seeded_permutation", f"WITH {IDS} SELECT subject_id, {perm_sql(7)} AS rank FROM ids")
def seeded_permutation(spark, d):
    return draws.permuted(customers(spark, d).select("subject_id"), "subject_id", 7)


@query("l1_kfold", f"""WITH {IDS}, r AS (SELECT subject_id, {perm_sql(42)} AS rk, count(*) OVER () AS n FROM ids),
o AS (SELECT subject_id, CASE WHEN rk < (n % 7) * (n // 7 + 1) THEN rk // (n // 7 + 1) ELSE n % 7 + (rk - (n % 7) * (n // 7 + 1)) // (n // 7) END AS own FROM r)
SELECT CAST(f AS INTEGER) AS fold, CASE WHEN own = f THEN 'validation' ELSE 'train' END AS role, subject_id FROM o, range(7) x(f)""")
def kfold(spark, d):
    return splits.kfold(customers(spark, d), "subject_id", 7)


@query("l2_repeated_split", f"""WITH {IDS} SELECT CAST(f AS INTEGER) AS fold, CASE WHEN site = 'BUILDING' THEN 'test' ELSE 'train' END AS role, subject_id FROM ids, range(3) x(f)""")
def repeated_split(spark, d):
    ids = customers(spark, d)
    return splits.repeated_split(ids.where("site <> 'BUILDING'"), ids.where("site = 'BUILDING'"), "subject_id", 3)


@query("l3_rolling_test_windows", f"""WITH {IDS}, r AS (SELECT subject_id, {perm_sql(42)} AS rk, count(*) OVER () AS n FROM ids)
SELECT CAST(f AS INTEGER) AS fold, CASE WHEN ((rk - f * 41) % n + n) % n < 41 THEN 'test' ELSE 'train' END AS role, subject_id FROM r, range(5) x(f)""")
def rolling_windows(spark, d):
    return splits.rolling_test_windows(customers(spark, d), "subject_id", 5, 41)


@query("e9_wraparound_window", f"""WITH {IDS}, r AS (SELECT subject_id, site, {perm_sql(42)} AS rk, count(*) OVER () AS n FROM ids)
SELECT CAST(f AS INTEGER) AS fold, count(*) AS tested FROM r, range(4) x(f) WHERE ((rk - f * 61) % n + n) % n < 61 GROUP BY f""")
def wraparound(spark, d):
    out = splits.rolling_test_windows(customers(spark, d), "subject_id", 4, 61)
    return out.where("role = 'test'").groupBy("fold").agg(F.count(F.lit(1)).alias("tested"))


@query("l4_participant_split", f"WITH {S.SPLITS} SELECT participant, split FROM split_map")
def participant_split(spark, d):
    return splits.participant_split(t.records(spark, d).select("participant").distinct(), "participant")


@query("j1_split_join", f"""WITH {S.SPLITS} SELECT split, label, count(*) AS records, count(DISTINCT participant) AS participants
FROM records JOIN split_map USING (participant) GROUP BY split, label""")
def split_join(spark, d):
    mapped = t.split_records(spark, d)
    per = mapped.groupBy("split", "label", "participant").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split", "label").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("participants"))


@query("l5_validation_split", f"""WITH {IDS}, r AS (SELECT subject_id, {perm_sql(5)} AS rk, count(*) OVER () AS n FROM ids)
SELECT subject_id, CASE WHEN rk < greatest(1, ceil(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""")
def validation_split(spark, d):
    return splits.validation_split(customers(spark, d), "subject_id", 0.1, 5, "ceil")


@query("l6_extend_split_map", f"""WITH {IDS}, known AS (SELECT subject_id, 'val' AS split FROM ids WHERE site = 'BUILDING'),
u AS (SELECT subject_id FROM ids WHERE site <> 'BUILDING'),
r AS (SELECT subject_id, {perm_sql(73)} AS rk, count(*) OVER () AS n FROM u),
shares AS (SELECT i, f * (SELECT count(*) FROM u) AS raw FROM (VALUES (0, 0.70::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) x(i, f)),
fl AS (SELECT i, floor(raw) AS base, raw - floor(raw) AS frac, (SELECT count(*) FROM u) - sum(floor(raw)) OVER () AS rest FROM shares),
ct AS (SELECT i, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, i) <= rest THEN 1 ELSE 0 END AS c FROM fl),
up AS (SELECT i, sum(c) OVER (ORDER BY i) AS upto FROM ct)
SELECT subject_id, split, true AS kept FROM known UNION ALL
SELECT subject_id, CASE WHEN rk < (SELECT upto FROM up WHERE i = 0) THEN 'train' WHEN rk < (SELECT upto FROM up WHERE i = 1) THEN 'val' ELSE 'test' END, false FROM r""")
def extend_map(spark, d):
    ids = customers(spark, d)
    known = ids.where("site = 'BUILDING'").select("subject_id", F.lit("val").alias("split"))
    return splits.extend_split_map(ids, known, "subject_id")


CANDIDATES = """cand AS (SELECT z, record_id, participant, row_number() OVER (PARTITION BY z ORDER BY md5('11|' || record_id), record_id) - 1 AS r,
 count(*) OVER (PARTITION BY z) AS n FROM records)"""


def balance_sql(target):
    return f"""WITH {S.RECORDS}, {CANDIDATES}
SELECT z, record_id, n AS balance_count, CAST(c AS INTEGER) AS duplicate_copy_id, (n <= {target} AND c >= {target} // n) AS is_extra_sample
FROM cand, range({target}) x(c) WHERE c < {target} // n + CASE WHEN r < {target} % n THEN 1 ELSE 0 END"""


@query("l7_balance_by_z", f"""WITH {S.RECORDS}, {CANDIDATES}, tgt AS (SELECT (max(n) + min(n)) // 2 AS t FROM cand), k AS (SELECT *, t // n + CASE WHEN r < t % n THEN 1 ELSE 0 END AS copies FROM cand, tgt)
SELECT z, record_id, n AS balance_count, CAST(unnest(range(copies)) AS INTEGER) AS duplicate_copy_id, t FROM k""".replace(
    "SELECT z, record_id, n AS balance_count, CAST(unnest(range(copies)) AS INTEGER) AS duplicate_copy_id, t FROM k",
    "e AS (SELECT z, record_id, n, t, unnest(range(copies)) AS c FROM k) "
    "SELECT z, record_id, n AS balance_count, CAST(c AS INTEGER) AS duplicate_copy_id, (n <= t AND c >= t // n) AS is_extra_sample FROM e").replace(", k AS (", ", k AS (").replace("FROM cand, tgt)\n", "FROM cand, tgt), "))
def balance_by_z(spark, d):
    rows = t.records(spark, d).select("z", "record_id")
    sizes = rows.groupBy("z").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.min("n")).first()
    out = splits.balance_by_level(rows, "z", "record_id", (sizes[0] + sizes[1]) // 2, 11)
    return out.select("z", "record_id", "balance_count", "duplicate_copy_id", "is_extra_sample")


QUOTA = """ref AS (SELECT CAST(floor(l_quantity / 10) AS INTEGER) AS bucket, count(*) AS weight FROM lineitem GROUP BY 1),
raw AS (SELECT bucket, weight, {total} * weight / sum(weight) OVER () AS raw FROM ref),
quota AS (SELECT bucket, weight, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, bucket) <= {total} - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM raw)"""


def reference_histogram(spark, d):
    bucket = F.floor(F.col("l_quantity") / 10).cast("int").alias("bucket")
    return t.table(spark, d, "lineitem").groupBy(bucket).agg(F.count(F.lit(1)).alias("weight"))


@query("l8_quotas", f"WITH {QUOTA.format(total=69000)} SELECT bucket, weight, quota FROM quota")
def quotas(spark, d):
    return splits.quotas(reference_histogram(spark, d), "bucket", "weight", 69000)


DRAW = f"""{S.RECORDS}, {QUOTA.format(total='(SELECT 2 * count(*) FROM records)')},
src AS (SELECT record_id, z, CAST(z % 6 AS INTEGER) AS bucket FROM records),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('73|' || record_id), record_id) - 1 AS r, count(*) OVER (PARTITION BY bucket) AS n FROM src),
e AS (SELECT record_id, n.bucket, unnest(range(1, 1 + quota // n + CASE WHEN r < quota % n THEN 1 ELSE 0 END)) AS duplicate_sequence FROM n JOIN quota USING (bucket))"""


def drawn(spark, d):
    rows = t.records(spark, d).select("record_id", (F.col("z") % 6).cast("int").alias("bucket"))
    quota = splits.quotas(reference_histogram(spark, d), "bucket", "weight", 2 * rows.count())
    return splits.draw_by_quota(rows, "bucket", "record_id", quota, 73)


@query("e6_copy_numbers", f"WITH {DRAW} SELECT record_id, bucket, CAST(duplicate_sequence AS INTEGER) AS duplicate_sequence FROM e")
def copy_numbers(spark, d):
    return drawn(spark, d).select("record_id", "bucket", F.col("duplicate_sequence").cast("int").alias("duplicate_sequence"))


@query("l8_bucket_draw", f"""WITH {DRAW} SELECT bucket, count(*) AS rows_out, count(DISTINCT record_id) AS distinct_sources, CAST(max(duplicate_sequence) AS INTEGER) AS max_copies FROM e GROUP BY bucket""")
def bucket_draw(spark, d):
    # Dealt by source before the count: adaptive execution would put small files, but many sources, in one task.
    rows = drawn(spark, d).repartition(4 * parallelism(spark), "record_id")
    per = rows.groupBy("bucket", "record_id").agg(F.count(F.lit(1)).alias("n"), F.max("duplicate_sequence").alias("m"))
    return per.groupBy("bucket").agg(
        F.sum("n").alias("rows_out"), F.count(F.lit(1)).alias("distinct_sources"), F.max("m").cast("int").alias("max_copies")
    )


@query("l9_matched_pairs", f"""WITH {S.PAIRS} SELECT split, pair_id, participant, case_id, label, z_bin, z, record_id FROM paired""")
def matched_pairs(spark, d):
    return t.paired_records(spark, d).select("split", "pair_id", "participant", "case_id", "label", "z_bin", "z", "record_id")


def full_pairing(spark, d):
    mapped = t.split_records(spark, d)
    return pairing.build_pairs(mapped.where("label = 0"), mapped.where("label = 1"), seed=t.SEED)


@query("l9_pair_summaries", f"""WITH {S.PAIRS}, h AS (SELECT pair_id, count(*) FILTER (WHERE label = 0) AS slice_count_per_domain,
 min(case_id) FILTER (WHERE label = 0) AS healthy_case, min(case_id) FILTER (WHERE label = 1) AS lesion_case FROM paired GROUP BY pair_id)
SELECT m.pair_id, split, healthy, lesion, healthy_case, lesion_case, slice_count_per_domain FROM matched m JOIN h USING (pair_id)""")
def pair_summaries(spark, d):
    return full_pairing(spark, d).pairs.drop("z_histogram", "cap_per_bin")


@query("l9_pair_exclusions", f"""WITH {S.PAIRS} SELECT split, healthy, lesion, 'no_common_z_bin' AS reason FROM matched WHERE pair_id NOT IN (SELECT pair_id FROM paired)""")
def pair_exclusions(spark, d):
    return full_pairing(spark, d).exclusions


@query("l12_pair_label_flip", f"""WITH {S.predictions(split=None)} SELECT record_id, pair_id, CAST(xor(label, {S.hash_long("'5'", "pair_id")} % 2) AS INTEGER) AS label,
 CAST({S.hash_long("'5'", "pair_id")} % 2 AS INTEGER) AS flipped FROM predictions""")
def pair_flip(spark, d):
    return pairing.flip_by_pair(t.predictions(spark, d, split=None), 5).select("record_id", "pair_id", "label", "flipped")


@query("l13_participant_label_shuffle", f"""WITH {S.PAIRS}, p AS (SELECT DISTINCT participant, label FROM paired),
a AS (SELECT label, row_number() OVER (ORDER BY md5('9:labels|' || participant), participant) AS r FROM p),
b AS (SELECT participant, row_number() OVER (ORDER BY md5('9:ids|' || participant), participant) AS r FROM p),
m AS (SELECT participant, a.label FROM a JOIN b USING (r)) SELECT record_id, participant, m.label FROM paired JOIN m USING (participant)""")
def label_shuffle(spark, d):
    return pairing.shuffle_participant_labels(t.paired_records(spark, d), 9).select("record_id", "participant", "label")


@query("l14_balanced_flip", f"""WITH {S.PAIRS}, p AS (SELECT DISTINCT split, pair_id FROM paired WHERE split IN ('train', 'val')),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('3|' || pair_id), pair_id) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM p),
f AS (SELECT pair_id FROM r WHERE r < n // 2)
SELECT record_id, split, CAST(xor(label, f.pair_id IS NOT NULL::INTEGER) AS INTEGER) AS label, CAST(f.pair_id IS NOT NULL AS INTEGER) AS flipped
FROM paired LEFT JOIN f USING (pair_id)""".replace("xor(label, f.pair_id IS NOT NULL::INTEGER)", "xor(label, CAST(f.pair_id IS NOT NULL AS INTEGER))"))
def balanced_flip(spark, d):
    return pairing.balanced_flip(t.paired_records(spark, d), 3).select("record_id", "split", "label", "flipped")


@query("l15_case_partition", f"""WITH {S.RECORDS}, c AS (SELECT DISTINCT source, case_id FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('73|' || case_id), case_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM c)
SELECT source, case_id, CASE WHEN r < floor(n * 0.67::DOUBLE) THEN 'explore' ELSE 'confirm' END AS partition FROM r""")
def case_partition(spark, d):
    cases = t.records(spark, d).select("source", "case_id").distinct()
    return pairing.case_partition(cases, "source", "case_id", 0.67, 73)


@query("l16_experiment_plan", """WITH c AS (SELECT r_name AS cohort, count(*) AS participants FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
p AS (SELECT * FROM c, (VALUES ('FLAIR'), ('FLAIR+T1+T2')) m(modalities), (VALUES ('cnn'), ('logistic')) k(model), (VALUES (73), (74), (75)) s(seed))
SELECT * FROM p WHERE model <> 'logistic' OR seed = 73""")
def experiment_plan(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cohorts = c.groupBy(F.col("r_name").alias("cohort")).agg(F.count(F.lit(1)).alias("participants"))
    return pairing.experiment_plan(cohorts, ["FLAIR", "FLAIR+T1+T2"], ["cnn", "logistic"], [73, 74, 75])


@query("e1_global_ordinal", f"WITH {S.RECORDS} SELECT case_id, z, row_number() OVER (ORDER BY case_id, z) - 1 AS slice_key FROM records")
def global_ordinal(spark, d):
    from cohortlens.operators.scale import banded, ordinals

    # Bands on case and depth together: a case with very many slices is split as well.
    rows = t.records(spark, d).select("case_id", "z", (F.col("case_id") * t.DEPTH + F.col("z")).alias("k"))
    return ordinals(banded(rows, "k"), [], ["k"], "slice_key").drop("k")


@query("p10_primary_case", f"""WITH {S.RECORDS}, f AS (SELECT participant, min(case_id) AS case_id FROM records GROUP BY participant)
SELECT participant, case_id, z FROM records JOIN f USING (participant, case_id)""")
def primary_case(spark, d):
    return pairing.primary_case(t.records(spark, d)).select("participant", "case_id", "z")


@query("e8_first_per_group", f"""WITH {S.RECORDS} SELECT participant, min(case_id) AS first_case, arg_min(z, (case_id, z)) AS first_z FROM records GROUP BY participant""")
def first_per_group(spark, d):
    first = t.records(spark, d).groupBy("participant").agg(F.min(F.struct("case_id", "z")).alias("f"))
    return first.select("participant", F.col("f.case_id").alias("first_case"), F.col("f.z").alias("first_z"))


@query("f1_manifest_order", f"""WITH {S.PAIRS} SELECT record_id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, pair_id, label, z_bin, z, record_id) - 1 AS position FROM paired""")
def manifest_order(spark, d):
    from cohortlens.operators.scale import BAND, ordinals

    rows = t.paired_records(spark, d).withColumn("_s", splits.order_map("split", splits.SPLITS))
    # The pair id ends in a uniform hexadecimal hash, so (split, leading hash digits) is a balanced monotone band.
    digits = F.conv(F.substring(F.substring_index("pair_id", ":", -1), 1, 6), 16, 10).cast("long")
    bands = parallelism(spark)
    band = (F.col("_s") * bands + F.floor(digits * bands / F.lit(16 ** 6))).cast("int")
    return ordinals(rows.withColumn(BAND, band), [], ["_s", "pair_id", "label", "z_bin", "z", "record_id"], "position").select("record_id", "position")


@query("f5_stratified_sample", f"""WITH {S.RECORDS}, n AS (SELECT participant, record_id, row_number() OVER (PARTITION BY participant ORDER BY md5('4|' || record_id), record_id) - 1 AS r,
 count(*) OVER (PARTITION BY participant) AS n FROM records),
s AS (SELECT participant, n, slot, {S.hash_long("'4'", "participant || '|' || slot")} % n AS r FROM (SELECT DISTINCT participant, n FROM n WHERE n < 30), range(30) x(slot))
SELECT participant, record_id, r AS slot FROM n WHERE n >= 30 AND r < 30 UNION ALL SELECT n.participant, n.record_id, slot FROM s JOIN n USING (participant, r)""")
def stratified(spark, d):
    return splits.stratified_sample(t.records(spark, d).select("participant", "record_id"), "participant", "record_id", 30, 4)


@query("f6_tiny_set", f"""WITH {S.RECORDS}, p AS (SELECT DISTINCT participant, label FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('2|' || participant), participant) AS r FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY z, record_id) AS k FROM records WHERE participant IN (SELECT participant FROM r WHERE r <= 8))
SELECT participant, label, record_id FROM k ORDER BY k, label, participant LIMIT 64""")
def tiny_set(spark, d):
    return splits.tiny_set(t.records(spark, d), "participant", "label", 8, 64, 2, ["z", "record_id"]).select("participant", "label", "record_id")
