"""Audits and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.functions import digests, scalars
from cohortlens.operators import audits, normalize, sets, splits
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t
from cohortlens.sources import writers

# A manifest with planted faults, so that every rule has something to find.
FAULTY = f"""{S.SPLITS}, fr AS (SELECT participant, case_id, z, z_norm, CASE WHEN source_key % 43 = 0 THEN z_bin + 1 ELSE z_bin END AS z_bin, label, domain,
 CASE WHEN source_key % 61 = 0 THEN 'val' ELSE split END AS split, CASE WHEN source_key % 47 = 0 THEN 'set:dup' ELSE record_id END AS record_id, CASE WHEN source_key % 67 = 0 THEN 5 WHEN label = 1 THEN 0 END AS mask_voxels
 FROM records JOIN split_map USING (participant))"""


def faulty(spark, d):
    mapped = t.split_records(spark, d)
    k = F.col("source_key")
    return mapped.withColumns({
        "z_bin": F.when(k % 43 == 0, F.col("z_bin") + 1).otherwise(F.col("z_bin")),
        "split": F.when(k % 61 == 0, "val").otherwise(F.col("split")),
        "record_id": F.when(k % 47 == 0, "set:dup").otherwise(F.col("record_id")),
        "mask_voxels": F.when(k % 67 == 0, 5).when(F.col("label") == 1, 0),
    })


@query("n1_record_audit", f"""WITH {FAULTY} SELECT 'z_bin_mismatch' AS rule, record_id AS key FROM fr WHERE z_bin <> least(19, floor(z_norm * 20))
UNION ALL SELECT 'z_out_of_range', record_id FROM fr WHERE z_bin > 19 OR z_norm > 1 UNION ALL SELECT 'lesion_voxels', record_id FROM fr WHERE mask_voxels <> 0
UNION ALL SELECT 'duplicate_record', record_id FROM fr GROUP BY record_id HAVING count(*) > 1
UNION ALL SELECT 'participant_in_several_splits', CAST(participant AS VARCHAR) FROM fr GROUP BY participant HAVING count(DISTINCT split) > 1""")
def record_audit(spark, d):
    return audits.record_audit(faulty(spark, d))


PAIR_FAULTS = f"""{S.PAIRS}, pf AS (SELECT * REPLACE (CASE WHEN source_key % 59 = 0 THEN z_bin + 1 ELSE z_bin END AS z_bin, CASE WHEN source_key % 71 = 0 THEN 'val' ELSE split END AS split) FROM paired)"""


def pair_faults(spark, d):
    rows = staged(t.paired_records(spark, d))
    k = F.col("source_key")
    return rows.withColumns({"z_bin": F.when(k % 59 == 0, F.col("z_bin") + 1).otherwise(F.col("z_bin")), "split": F.when(k % 71 == 0, "val").otherwise(F.col("split"))})


@query("n2_pair_audit", f"""WITH {PAIR_FAULTS}, b AS (SELECT pair_id, z_bin, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM pf GROUP BY ALL)
SELECT 'z_histogram_mismatch' AS rule, pair_id AS key FROM b GROUP BY pair_id HAVING bool_or(n0 <> n1) UNION ALL SELECT 'per_bin_cap', pair_id FROM b GROUP BY pair_id HAVING max(greatest(n0, n1)) > 2
UNION ALL SELECT 'slice_count_mismatch', pair_id FROM b GROUP BY pair_id HAVING sum(n0) <> sum(n1) UNION ALL SELECT 'split_mismatch', pair_id FROM pf GROUP BY pair_id HAVING count(DISTINCT split) > 1""")
def pair_audit(spark, d):
    return audits.pair_audit(pair_faults(spark, d))


@query("n3_audit_summary", f"""WITH {S.PAIRS} SELECT 'split' AS dimension, split AS value, count(*) AS rows FROM paired GROUP BY split UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM paired GROUP BY label UNION ALL SELECT 'domain', domain, count(*) FROM paired GROUP BY domain""")
def audit_summary(spark, d):
    return audits.counts_by(t.paired_records(spark, d), ["split", "label", "domain"])


@query("n4_provenance", """WITH m AS (SELECT lang, source FROM documents) SELECT 'lang_hash' AS field, md5(lang) AS value, count(*) AS "references" FROM m GROUP BY ALL UNION ALL SELECT 'source_hash', md5(source), count(*) FROM m GROUP BY ALL""")
def provenance(spark, d):
    docs = t.table(spark, d, "documents").select(F.create_map(F.lit("lang_hash"), F.md5("lang"), F.lit("source_hash"), F.md5("source"), F.lit("path"), F.col("source")).alias("m"))
    return audits.provenance(docs, "m", "_hash$")


@query("n3_pair_summaries", f"""WITH {S.PAIRS}, h AS (SELECT pair_id, z_bin, count(*) AS n FROM paired WHERE label = 0 GROUP BY ALL), hs AS (SELECT pair_id, string_agg(z_bin || ':' || n, ',' ORDER BY z_bin) AS z_histogram FROM h GROUP BY pair_id)
SELECT pair_id, CASE WHEN count(DISTINCT split) = 1 THEN min(split) END AS split, count(*) AS records, count(*) FILTER (WHERE label = 0) AS slices_per_domain, any_value(z_histogram) AS z_histogram, list_sort(list(DISTINCT participant)) AS participants
FROM paired LEFT JOIN hs USING (pair_id) GROUP BY pair_id""")
def pair_summaries(spark, d):
    out = audits.pair_summaries(t.paired_records(spark, d))
    return out.withColumn("z_histogram", F.array_join(F.transform(F.map_entries("z_histogram"), lambda e: F.concat_ws(":", e.key, e.value)), ","))


@query("n4_distinct_paths", """SELECT field, count(DISTINCT value) AS values, count(*) AS "references" FROM (SELECT 'page_path' AS field, regexp_replace(url, '[0-9]+', '#', 'g') AS value FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'source_path', source FROM documents WHERE source IS NOT NULL) GROUP BY field""")
def distinct_paths(spark, d):
    pages = t.table(spark, d, "pages").select(F.create_map(F.lit("page_path"), F.regexp_replace("url", "[0-9]+", "#"), F.lit("sha"), F.md5("url")).alias("m")).where("m['page_path'] IS NOT NULL")
    docs = t.table(spark, d, "documents").select(F.create_map(F.lit("source_path"), F.col("source"), F.lit("sha"), F.md5("text")).alias("m")).where("m['source_path'] IS NOT NULL")
    return audits.distinct_values(pages.unionByName(docs), "m", "_path$")


@query("d24_manifest_provenance", f"""WITH {S.SPLITS}, s AS (SELECT site, coalesce(split, '') AS split, participant, case_id FROM records LEFT JOIN split_map USING (participant)), c AS (SELECT site, split, count(*) AS n FROM s GROUP BY ALL)
SELECT site, count(*) AS rows, ['site', 'participant', 'case_id', 'split'] AS columns, (SELECT string_agg(split || ':' || n, ',' ORDER BY split) FROM c WHERE c.site = s.site) AS split_counts, count(DISTINCT participant) AS subjects, count(DISTINCT (participant, case_id)) AS sessions FROM s GROUP BY site""")
def manifest_provenance(spark, d):
    split = t.split_records(spark, d).select("participant", "split").distinct()
    rows = t.records(spark, d).select("site", "participant", "case_id").join(split, "participant", "left").select("site", "participant", "case_id", "split")
    out = audits.manifest_provenance(rows, ["site"], "split", "participant", "case_id")
    return out.withColumn("split_counts", F.array_join(F.transform(F.map_entries("split_counts"), lambda e: F.concat_ws(":", e.key, e.value)), ","))


STEPS = 128


@query("n19_distributions", f"""WITH i AS (SELECT l_suppkey AS case_id, l_linestatus AS modality, l_returnflag AS cohort, l_extendedprice AS v FROM lineitem),
rc AS (SELECT case_id, unnest(range({STEPS + 1})) AS i, unnest(quantile_cont(v, [{', '.join(str(j / STEPS) for j in range(STEPS + 1))}])) AS q FROM i WHERE cohort = 'R' GROUP BY case_id), target AS (SELECT i, avg(q) AS q FROM rc GROUP BY i),
b AS (SELECT modality, 'before' AS version, v FROM i UNION ALL SELECT modality, 'after', v * 0.75 + 1000 FROM i),
g AS (SELECT modality, version, t.i, t.q, count(*) FILTER (WHERE v <= t.q) / count(*) AS f FROM b CROSS JOIN target t GROUP BY ALL), e AS (SELECT *, abs(f - i / {STEPS}) AS e FROM g),
a AS (SELECT *, (e + lag(e) OVER w) / 2 * (q - lag(q) OVER w) AS area FROM e WINDOW w AS (PARTITION BY modality, version ORDER BY i)),
ds AS (SELECT modality, version, max(e) AS err, sum(area) / (max(q) FILTER (WHERE i = {3 * STEPS // 4}) - max(q) FILTER (WHERE i = {STEPS // 4})) AS w FROM a GROUP BY ALL)
SELECT modality, version, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 3) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 3) AS iqr, round(quantile_cont(v, 0.95), 3) AS p95, round(quantile_cont(v, 0.99), 3) AS p99,
 round(any_value(err), 8) AS cdf_max_error, round(any_value(w), 7) AS wasserstein_over_iqr FROM b JOIN ds USING (modality, version) GROUP BY modality, version""")
def read_back_distributions(spark, d):
    before = t.intensities(spark, d)
    curve = normalize.reference_curve(before.where("cohort = 'R'"), ["case_id"], [], "v", STEPS)
    target = staged(curve.withColumn("modality", F.explode(F.array(F.lit("F"), F.lit("O")))))
    out = audits.read_back_distributions(before, before.withColumn("v", F.col("v") * 0.75 + 1000), ["modality"], "v", target, STEPS)
    return out.withColumns({c: F.round(c, 4 if c in ("mean", "std") else 3) for c in ("mean", "std", "median", "iqr", "p95", "p99")}).withColumns({"cdf_max_error": F.round("cdf_max_error", 8), "wasserstein_over_iqr": F.round("wasserstein_over_iqr", 7)})


@query("n5_frozen_counts", f"""WITH {S.SPLITS}, a AS (SELECT split, label, count(*) AS actual FROM records JOIN split_map USING (participant) GROUP BY ALL),
e AS (SELECT split, label, CASE WHEN split = 'val' THEN actual + 1 ELSE actual END AS expected FROM a WHERE NOT (split = 'test' AND label = 1))
SELECT a.split, a.label, actual, expected, coalesce(actual = expected, false) AS ok FROM a LEFT JOIN e ON a.split = e.split AND a.label = e.label""")
def frozen_counts(spark, d):
    mapped = t.split_records(spark, d)
    actual = staged(mapped.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))
    expected = actual.where("NOT (split = 'test' AND label = 1)").withColumn("n", F.col("n") + F.when(F.col("split") == "val", 1).otherwise(0))
    return audits.expectations(actual, expected, ["split", "label"], "n")


@query("n6_grid_checks", f"""WITH {FAULTY} SELECT 'z_norm' AS rule, record_id AS key FROM fr WHERE abs(z_norm - z / 6.0::DOUBLE) > 1e-12 OR z_norm IS NULL UNION ALL SELECT 'zero_mask', record_id FROM fr WHERE mask_voxels > 0
UNION ALL SELECT 'support', record_id FROM fr WHERE case_id % 101 = 0 UNION ALL SELECT 'split_overlap', CAST(participant AS VARCHAR) FROM fr GROUP BY participant HAVING count(DISTINCT split) > 1""")
def grid_checks(spark, d):
    rows = faulty(spark, d)
    rules = {
        "z_norm": F.abs(F.col("z_norm") - F.col("z") / 6) <= 1e-12,
        "zero_mask": F.coalesce(F.col("mask_voxels") <= 0, F.lit(True)),
        "support": F.col("case_id") % 101 != 0,
    }
    overlap = rows.groupBy("participant").agg(F.countDistinct("split").alias("n")).where("n > 1")
    return sets.union([audits.rule_violations(rows, F.col("record_id"), rules), sets.tagged("split_overlap", overlap, F.col("participant"))])


@query("n7_calibration_audit", """WITH n AS (SELECT max(p_partkey) + 20 AS n FROM part), x AS (SELECT unnest(range(n)) AS run FROM n), a AS (SELECT p_partkey AS run, p_size <= 48 AS size_ok, p_retailprice < 950 AS price_ok FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, true, true FROM part WHERE p_partkey % 77 = 1),
g AS (SELECT run, count(*) AS n, bool_and(size_ok) AS s, bool_and(price_ok) AS p FROM a GROUP BY run)
SELECT x.run, list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN NOT s THEN 'size' END, CASE WHEN NOT p THEN 'price' END], lambda v: v IS NOT NULL) AS problems,
 CASE WHEN n IS NULL THEN 'INCOMPLETE' WHEN n > 1 OR NOT s OR NOT p THEN 'FAIL' ELSE 'PASS' END AS status FROM x LEFT JOIN g ON x.run = g.run""")
def calibration_audit(spark, d):
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("run"), "p_size", "p_retailprice")
    last = part.agg(F.max("run")).first()[0]
    expected = spark.range(last + 20).withColumnRenamed("id", "run")
    again = part.where("run % 77 = 1").withColumns({"p_size": F.lit(1), "p_retailprice": F.lit(1.0)})
    artifacts = part.where("run % 7 <> 0").unionByName(again)
    return audits.artifact_audit(expected, artifacts, "run", {"size": F.col("p_size") <= 48, "price": F.col("p_retailprice") < 950})


@query("n8_expectations", """WITH a AS (SELECT o_orderstatus AS status, count(*) AS actual FROM orders GROUP BY 1), e AS (SELECT DISTINCT o_orderstatus AS status, (SELECT count(*) FROM orders) // 3 AS expected FROM orders)
SELECT status, actual, expected, actual = expected AS ok FROM a JOIN e USING (status)""")
def expectations(spark, d):
    orders = t.table(spark, d, "orders")
    actual = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    third = orders.count() // 3
    return audits.expectations(actual, actual.select("status", F.lit(third).cast("long").alias("n")), ["status"], "n")


QC = """qc AS (SELECT p_partkey AS session_id, p_size > 1 AS image_finite, true AS mask_finite, p_retailprice > 901 AS geometry_valid, true AS shape_valid, avg(l_quantity) / 15 AS brain_volume_L, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE avg(l_discount) END AS det,
 min(l_quantity) AS sv_min, max(l_quantity) / 12.5 AS sv_max, 1 - p_size / 150.0::DOUBLE AS mask_dice, avg(l_tax) - 0.02 AS T1_MNI_MI_improvement, avg(l_discount) - 0.02 AS FLAIR_T1_MI_improvement, 0.1::DOUBLE AS T2_T1_MI_improvement, 1 - p_size / 1500.0::DOUBLE AS guard_retention
 FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size, p_retailprice)"""


def qc_rows(spark, d):
    lines = t.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_tax").alias("tx"))
    # Means of hundredths that lie on a limit do so in whatever order they were summed.
    lines = lines.withColumns({"dd": F.round("dd", 12), "tx": F.round("tx", 12)})
    rows = t.table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(
        F.col("p_partkey").alias("session_id"), (F.col("p_size") > 1).alias("image_finite"), F.lit(True).alias("mask_finite"), (F.col("p_retailprice") > 901).alias("geometry_valid"), F.lit(True).alias("shape_valid"),
        (F.col("q") / 15).alias("brain_volume_L"), F.when(F.col("p_partkey") % 97 != 0, F.col("dd")).alias("det"), F.col("lo").alias("sv_min"), (F.col("hi") / 12.5).alias("sv_max"), (1 - F.col("p_size") / 150).alias("mask_dice"),
        (F.col("tx") - 0.02).alias("T1_MNI_MI_improvement"), (F.col("dd") - 0.02).alias("FLAIR_T1_MI_improvement"), F.lit(0.1).alias("T2_T1_MI_improvement"), (1 - F.col("p_size") / 1500).alias("guard_retention"))


QC_FLAGS = """fl AS (SELECT session_id, list_filter([CASE WHEN NOT image_finite THEN 'FAIL:image_finite' END, CASE WHEN NOT geometry_valid THEN 'FAIL:geometry_valid' END,
 CASE WHEN NOT brain_volume_L BETWEEN 0.5 AND 2.5 THEN 'FAIL:brain_volume_outside_0.5_2.5_L' END, CASE WHEN det IS NULL OR det <= 0 THEN 'FAIL:nonpositive_or_nonfinite_determinant' END,
 CASE WHEN sv_min < 0.25 OR sv_max > 4 THEN 'FAIL:catastrophic_singular_value' END, CASE WHEN mask_dice < 0.7::DOUBLE THEN 'FAIL:mask_dice_below_0.70' END, CASE WHEN T1_MNI_MI_improvement <= 0 THEN 'REVIEW:T1_MNI_MI_improvement_nonpositive' END,
 CASE WHEN FLAIR_T1_MI_improvement <= 0 THEN 'REVIEW:FLAIR_T1_MI_improvement_nonpositive' END, CASE WHEN guard_retention < 0.98::DOUBLE THEN 'REVIEW:guard_retention_below_0.98' END], lambda x: x IS NOT NULL) AS flags FROM qc),
st AS (SELECT session_id, flags, CASE WHEN len(list_filter(flags, lambda x: starts_with(x, 'FAIL'))) > 0 THEN 'FAIL' WHEN len(flags) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM fl)"""


@query("n9_qc_status", f"WITH {QC}, {QC_FLAGS} SELECT session_id, flags, status FROM st")
def qc_status(spark, d):
    return audits.qc_status(qc_rows(spark, d)).select("session_id", "flags", "status")


FIELDS = ("mask_dice", "brain_volume_L", "det", "T1_MNI_MI_improvement", "guard_retention")
OUT = f"""lg AS (SELECT session_id AS id, field, value FROM (SELECT session_id, {', '.join(FIELDS)} FROM qc) UNPIVOT INCLUDE NULLS (value FOR field IN ({', '.join(FIELDS)}))),
md AS (SELECT field, median(value) AS m FROM lg GROUP BY field), dv AS (SELECT id, field, value, m, abs(value - m) AS dev FROM lg JOIN md USING (field)), ma AS (SELECT field, median(dev) AS mad FROM dv GROUP BY field),
zz AS (SELECT id, field, CASE WHEN value IS NULL THEN NULL WHEN mad <= 1e-12 THEN CASE WHEN dev <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END ELSE 0.67448975 * (value - m) / mad END AS z FROM dv JOIN ma USING (field)),
mg AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE least(abs(z), 1e12) END AS magnitude FROM zz)"""


@query("n10_outliers", f"""WITH {QC}, {OUT} SELECT id, round(max(magnitude), 8) AS outlier_score, count(*) FILTER (WHERE magnitude >= 3.5 AND magnitude < 1e12) AS alarms FROM mg GROUP BY id""")
def outliers(spark, d):
    out = audits.outliers(qc_rows(spark, d), "session_id", FIELDS)
    return out.select("id", F.round("outlier_score", 8).alias("outlier_score"), F.size("outlier_flags").cast("long").alias("alarms"))


def qc_long(spark, d):
    """Integer-valued fields, so that equal magnitudes tie exactly on both engines."""
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.round(F.col("p_retailprice") - 900).alias("price")).unpivot("id", ["size", "price"], "field", "value")


RANKS = """lg AS (SELECT p_partkey AS id, 'size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', round(p_retailprice - 900) FROM part),
md AS (SELECT field, median(value) AS m FROM lg GROUP BY field), rk AS (SELECT id, field, abs(value - m) AS dev, row_number() OVER (PARTITION BY field ORDER BY abs(value - m) DESC, id) AS rank FROM lg JOIN md USING (field)), ma AS (SELECT field, median(dev) AS mad FROM rk GROUP BY field)"""


@query("e2_field_ranks", f"WITH {RANKS} SELECT id, field, rank FROM rk")
def field_ranks(spark, d):
    long = staged(qc_long(spark, d))
    return audits.field_ranks(long, audits.modified_z(long)).select("id", "field", "rank")


@query("f2_most_suspicious", f"""WITH {RANKS}, g AS (SELECT id, min(rank) AS worst_rank, max(0.67448975 * dev / mad) AS s FROM rk JOIN ma USING (field) GROUP BY id)
SELECT id, worst_rank, round(s, 8) AS outlier_score FROM g ORDER BY worst_rank, s DESC, id LIMIT 15""")
def most_suspicious(spark, d):
    wide = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.round(F.col("p_retailprice") - 900).alias("price"))
    top = audits.most_suspicious(audits.outliers(wide, "id", ["size", "price"]), 15)
    return top.select("id", "worst_rank", F.round("outlier_score", 8).alias("outlier_score"))


REVIEW = f"""{QC}, {QC_FLAGS}, rv AS (SELECT session_id, session_id % 997 AS site, status, CASE WHEN status = 'REVIEW' THEN CASE session_id % 5 WHEN 0 THEN 'EXCLUDE' WHEN 1 THEN 'PENDING' ELSE 'PASS' END END AS manual, session_id % 10 = 0 AS allowed FROM st)"""


@query("n11_release_gate", f"""WITH {REVIEW}, r AS (SELECT site, coalesce(status = 'FAIL' OR (manual = 'EXCLUDE' AND NOT allowed), false) AS f, coalesce(allowed AND coalesce(manual, '') <> 'EXCLUDE' OR manual NOT IN ('PASS', 'EXCLUDE'), false) AS w FROM rv)
SELECT site, count(*) AS sessions, count(*) FILTER (WHERE f) AS failed, count(*) FILTER (WHERE w) AS waiting, CASE WHEN bool_or(f) THEN 'FAIL' WHEN bool_or(w) THEN 'PENDING_MANUAL_REVIEW' ELSE 'PASS' END AS release FROM r GROUP BY site""")
def release_gate(spark, d):
    rows = audits.qc_status(qc_rows(spark, d))
    k = F.col("session_id")
    manual = F.when(F.col("status") == "REVIEW", F.when(k % 5 == 0, "EXCLUDE").when(k % 5 == 1, "PENDING").otherwise("PASS"))
    return audits.release_gate(rows.select((k % 997).alias("site"), "status", manual.alias("manual"), (k % 10 == 0).alias("allowed")), ["site"], "status", "manual", "allowed")


@query("n12_review_queue", f"""WITH {QC}, {QC_FLAGS}, q AS (SELECT session_id, status FROM st WHERE status = 'REVIEW'), o AS (SELECT session_id, 'PASS' AS d, 'seen' AS n FROM q WHERE session_id % 4 = 0), a AS (SELECT session_id, 'EXCLUDE' AS d FROM q WHERE session_id % 6 = 0)
SELECT q.session_id, q.status, CASE WHEN o.d IS NULL THEN coalesce(a.d, 'PENDING') ELSE o.d END AS decision, coalesce(n, '') AS note FROM q LEFT JOIN o USING (session_id) LEFT JOIN a USING (session_id)""")
def review_queue(spark, d):
    queue = staged(audits.qc_status(qc_rows(spark, d)).where("status = 'REVIEW'").select("session_id", "status"))
    earlier = queue.where("session_id % 4 = 0").select("session_id", F.lit("PASS").alias("decision"), F.lit("seen").alias("note"))
    merged = audits.upsert_review_queue(queue, earlier, "session_id")
    return audits.adjudicate(merged, queue.where("session_id % 6 = 0").select("session_id", F.lit("EXCLUDE").alias("decision")), "session_id")


@query("n13_status_partitions", f"WITH {QC}, {QC_FLAGS} SELECT status, count(*) AS sessions FROM st GROUP BY status")
def status_partitions(spark, d):
    from cohortlens.sources import writers

    path = writers.write_partitioned(audits.qc_status(qc_rows(spark, d)).select("session_id", "status"), "status")
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("sessions"))


@query("n14_store_audit", """SELECT count(*) AS entries, 0::BIGINT AS repeated_keys, max(vec_id) + 1 = count(DISTINCT vec_id) AND min(vec_id) = 0 AS contiguous, bool_and(len(embedding) = 64) AS shape_ok, bool_and(list_sum(embedding) IS NOT NULL AND isfinite(list_sum(embedding))) AS finite_ok FROM embeddings""")
def store_audit(spark, d):
    return audits.store_audit(t.slices(spark, d), "slice_id", "px", 64)


TENSOR = "sha256(array_to_string(list_transform(embedding, lambda v: CAST(round(v::DOUBLE * 1e9) AS BIGINT)), ','))"


@query("n15_resampled_identity", f"""WITH r AS (SELECT vec_id, copy, CASE WHEN vec_id % 11 = 0 AND copy = 1 THEN list_transform(embedding, lambda v: v + 1) ELSE embedding END AS embedding FROM (SELECT *, unnest(range(1 + vec_id % 3)) AS copy FROM embeddings)),
w AS (SELECT vec_id, {TENSOR} AS h FROM r), o AS (SELECT vec_id, {TENSOR} AS h FROM embeddings)
SELECT w.vec_id AS source_key, count(*) AS copies, bool_and(w.h = o.h) AS identical FROM w JOIN o ON w.vec_id = o.vec_id GROUP BY w.vec_id""")
def resampled_identity(spark, d):
    # Copies are written and read back; some second copies are damaged on the way.
    source = t.slices(spark, d)
    copies = source.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slice_id") % 3)))
    damaged = (F.col("slice_id") % 11 == 0) & (F.col("copy") == 1)
    path = writers.scratch(spark, "resampled")
    copies.withColumn("px", F.when(damaged, F.transform("px", lambda v: (v + 1).cast("float"))).otherwise(F.col("px"))).write.parquet(path)
    a = spark.read.parquet(path).select(F.col("slice_id").alias("source_key"), digests.tensor_digest("px").alias("h"))
    b = source.select(F.col("slice_id").alias("source_key"), digests.tensor_digest("px").alias("want"))
    return a.join(b, "source_key").groupBy("source_key").agg(F.count(F.lit(1)).alias("copies"), F.bool_and(F.col("h") == F.col("want")).alias("identical"))


@query("n16_inventory_reasons", """WITH c AS (SELECT o_custkey AS visit, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1),
r AS (SELECT visit, list_filter([CASE WHEN f = 0 THEN 'missing_F' WHEN f > 1 THEN 'several_F' END, CASE WHEN o = 0 THEN 'missing_O' WHEN o > 1 THEN 'several_O' END], lambda x: x IS NOT NULL) AS reasons FROM c)
SELECT visit, reasons, CASE WHEN len(reasons) = 0 THEN 'READY' ELSE 'PARTIAL' END AS status FROM r""")
def inventory_reasons(spark, d):
    return audits.inventory_reasons(t.table(spark, d, "orders").select(F.col("o_custkey").alias("visit"), "o_orderstatus"), ["visit"], "o_orderstatus", ["F", "O"])


@query("n17_roster_equality", """WITH a AS (SELECT c_custkey AS pos, c_name AS s FROM customer WHERE c_custkey % 53 <> 0), b AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 31 = 0 THEN 'other' ELSE c_name END AS s FROM customer)
SELECT coalesce(a.pos, b.pos) AS pos, a.s AS a, b.s AS b FROM a FULL JOIN b ON a.pos = b.pos WHERE a.s IS DISTINCT FROM b.s""")
def roster_equality(spark, d):
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("s"))
    changed = c.withColumn("s", F.when(F.col("pos") % 31 == 0, "other").otherwise(F.col("s")))
    return audits.roster_equality(c.where("pos % 53 <> 0"), changed, "pos", "s")


@query("n18_completeness", f"""WITH {S.RECORDS}, a AS (SELECT participant, count(*) AS actual FROM records GROUP BY 1), e AS (SELECT o_custkey AS participant, count(DISTINCT (l_orderkey, l_linenumber)) + CASE WHEN o_custkey % 83 = 0 THEN 1 ELSE 0 END AS expected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT participant, actual, expected, actual = expected AS ok FROM a JOIN e USING (participant) WHERE actual <> expected""")
def completeness(spark, d):
    actual = t.records(spark, d).groupBy("participant").agg(F.count(F.lit(1)).alias("n"))
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    orders = t.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("participant"))
    expected = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("participant").agg(F.count(F.lit(1)).alias("n"))
    expected = expected.withColumn("n", F.col("n") + F.when(F.col("participant") % 83 == 0, 1).otherwise(0))
    return audits.expectations(actual, expected, ["participant"], "n").where("NOT ok")


@query("n19_read_back", """WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, max(l_discount) AS a FROM lineitem GROUP BY ALL)
SELECT g, count(*) AS rows, count(*) FILTER (WHERE a > 0.085) AS unmatched, true AS zero_mask_same, true AS positives_kept, count(*) FILTER (WHERE a > 0.085) = 0 AS finite,
 round(avg(a), 9) AS mean_before, round(avg(2 * a) FILTER (WHERE a <= 0.085), 9) AS mean_after, round(stddev_pop(a), 9) AS std_before, round(stddev_pop(2 * a) FILTER (WHERE a <= 0.085), 9) AS std_after FROM k GROUP BY g""")
def read_back(spark, d):
    keys = ["l_orderkey", "l_linenumber", "g"]
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g")).agg(F.max("l_discount").alias("v"))
    after = rows.where("v <= 0.085").withColumn("v", F.col("v") * 2)
    before = rows.withColumn("grp", F.col("g"))
    out = audits.read_back(before, after, keys, "grp", "v").withColumnRenamed("grp", "g")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_before", "mean_after", "std_before", "std_after")})


@query("n20_parity_summary", """SELECT o_orderpriority AS cohort, round(max(abs(o_totalprice - 250000)), 4) AS max_abs_difference, list_sort(list(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'shape' WHEN o_orderstatus = 'P' THEN 'value' END) FILTER (WHERE o_orderstatus <> 'O')) AS reasons,
 count(*) FILTER (WHERE o_orderstatus = 'O') AS pass_pairs, count(*) FILTER (WHERE o_orderstatus = 'P') AS incomplete_pairs, count(*) FILTER (WHERE o_orderstatus = 'F') AS fail_pairs FROM orders GROUP BY 1""")
def parity_summary(spark, d):
    s = F.col("o_orderstatus")
    rows = t.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("cohort"), (F.col("o_totalprice") - 250000).alias("difference"), F.when(s == "F", "shape").when(s == "P", "value").alias("reason"),
        F.when(s == "O", "PASS").when(s == "P", "INCOMPLETE").otherwise("FAIL").alias("status"))
    return audits.parity_summary(rows, "cohort").withColumn("max_abs_difference", F.round("max_abs_difference", 4))


@query("p17_tumor_free", f"""WITH {FAULTY} SELECT record_id, mask_voxels FROM fr WHERE label = 1 AND mask_voxels <> 0""")
def tumor_free(spark, d):
    return faulty(spark, d).where((F.col("label") == 1) & (F.col("mask_voxels") != 0)).select("record_id", "mask_voxels")


@query("p18_configured_exclusions", f"""WITH {S.SPLITS}, m AS (SELECT split, participant, count(*) AS n FROM records JOIN split_map USING (participant) GROUP BY ALL) SELECT split, count(*) AS before, count(*) FILTER (WHERE participant % 19 <> 0) AS after, CAST(sum(n) FILTER (WHERE participant % 19 <> 0) AS BIGINT) AS records FROM m GROUP BY split""")
def configured_exclusions(spark, d):
    mapped = t.split_records(spark, d)
    people = staged(mapped.groupBy("split", "participant").agg(F.count(F.lit(1)).alias("n")))
    configured = people.where("participant % 19 = 0").select("participant")
    # The adjudicated list comes from the register of customers; it has to name the same participants.
    register = t.table(spark, d, "customer").select(F.col("c_custkey").alias("participant")).where("pmod(participant, 19) = 0")
    adjudicated = register.join(people.select("participant"), "participant", "left_semi")
    sets.require_empty(sets.symmetric_difference(configured, adjudicated, "participant"), "configured and adjudicated exclusions differ")
    kept = sets.without(people, configured, "participant")
    before = people.groupBy("split").agg(F.count(F.lit(1)).alias("before"))
    return before.join(kept.groupBy("split").agg(F.count(F.lit(1)).alias("after"), F.sum("n").alias("records")), "split")


@query("g8_tensor_ledger", f"""SELECT label AS channel, vec_id % 50 AS scope, count(*) AS copies, min({TENSOR}) AS digest, min({TENSOR}) = max({TENSOR}) AS consistent FROM embeddings GROUP BY ALL""")
def tensor_ledger(spark, d):
    rows = t.slices(spark, d).withColumn("scope", F.col("slice_id") % 50)
    return digests.ledger(rows, ["channel", "scope"], "px")
