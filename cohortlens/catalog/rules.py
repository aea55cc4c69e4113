"""Rules of manifests, model grids and inventories, on tables with planted faults so that every rule has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import rules
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t

MANIFEST = f"""{S.PAIRS}, m0 AS (SELECT CASE WHEN source_key % 53 = 0 THEN 'test' ELSE split END AS split, CASE WHEN source_key % 71 = 0 THEN 'val' WHEN source_key % 5 = 0 THEN '' ELSE split END AS row_split,
 CASE WHEN source_key % 61 = 0 THEN '' ELSE CAST(participant AS VARCHAR) END AS participant, CASE WHEN source_key % 59 = 0 THEN '' ELSE pair_id END AS pair_id, CASE WHEN source_key % 67 = 0 THEN 2 WHEN source_key % 83 = 0 THEN 1 - label ELSE label END AS label,
 label AS was, 's' || source AS source_split, CASE WHEN label = 1 THEN 'Lesions' ELSE 'healthy_' || source END AS source_dataset, CASE WHEN source_key % 89 = 0 THEN '' ELSE record_id END AS source_id, case_id, z, source_key AS k FROM paired),
m AS MATERIALIZED (SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE k % 73 = 0), ok AS (SELECT * FROM m WHERE label < 2 AND source_id <> ''),
pr AS (SELECT pair_id, count(DISTINCT participant) AS people, count(DISTINCT split) AS splits, count(DISTINCT label) AS labels, count(DISTINCT (participant, label)) AS marks FROM ok WHERE pair_id <> '' GROUP BY 1),
rowrules AS (SELECT concat_ws(':', split, source_dataset, source_split, source_id, participant, pair_id, z) AS key, [CASE WHEN participant = '' THEN 'empty_participant_id' END, CASE WHEN pair_id = '' THEN 'empty_pair_id' END, CASE WHEN label = 2 THEN 'invalid_label' END,
  CASE WHEN label < 2 AND label <> was THEN 'label_source_mismatch' END, CASE WHEN label < 2 AND row_split NOT IN ('', split) THEN 'target_split_mismatch' END, CASE WHEN label < 2 AND k % 79 = 0 THEN 'manifest_shape' END, CASE WHEN label < 2 AND source_id = '' THEN 'invalid_source_identity' END] AS found FROM m),
wanted AS (SELECT 'records' AS measure, count(*) AS n FROM paired UNION ALL SELECT 'pairs', count(DISTINCT pair_id) FROM paired UNION ALL SELECT 'split:' || split, count(*) FROM paired GROUP BY split),
counted AS (SELECT 'records' AS measure, count(*) AS n FROM ok UNION ALL SELECT 'pairs', count(*) FROM pr UNION ALL SELECT 'split:' || split, count(*) FROM ok GROUP BY split),
viol AS MATERIALIZED (SELECT rule, key FROM (SELECT unnest(found) AS rule, key FROM rowrules) WHERE rule IS NOT NULL
UNION ALL SELECT 'duplicate_manifest_row', concat_ws(':', split, source_dataset, source_split, source_id, participant, case_id, z, pair_id, label) FROM ok GROUP BY split, source_dataset, source_split, source_id, participant, case_id, z, pair_id, label HAVING count(*) > 1
UNION ALL SELECT 'pair_crosses_splits', pair_id FROM pr WHERE splits > 1 UNION ALL SELECT 'pair_participant_count', pair_id FROM pr WHERE people <> 2 UNION ALL SELECT 'pair_labels_not_01', pair_id FROM pr WHERE people = 2 AND (labels <> 2 OR marks <> 2)
UNION ALL SELECT 'participant_conflicting_labels', pair_id || ':' || participant FROM ok WHERE pair_id <> '' GROUP BY pair_id, participant HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'missing_split', s FROM (VALUES ('train'), ('val'), ('test')) v(s) WHERE s NOT IN (SELECT split FROM m)
UNION ALL SELECT 'manifest_count_differs', w.measure FROM wanted w LEFT JOIN counted c USING (measure) WHERE coalesce(c.n, 0) <> w.n)"""


def report_sql(names) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT r.rule, count(viol.rule) AS failures, CASE WHEN count(viol.rule) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES {values}) r(rule) LEFT JOIN viol USING (rule) GROUP BY r.rule"


def manifest_violations(spark, d):
    paired = staged(t.paired_records(spark, d))
    k, healthy = F.col("source_key"), F.concat(F.lit("healthy_"), "source")
    rows = paired.select(
        F.when(k % 53 == 0, "test").otherwise(F.col("split")).alias("split"),
        F.when(k % 71 == 0, "val").when(k % 5 != 0, F.col("split")).alias("row_split"),
        F.when(k % 61 == 0, " ").otherwise(F.col("participant").cast("string")).alias("participant"),
        F.when(k % 59 == 0, "").otherwise(F.col("pair_id")).alias("pair_id"),
        F.when(k % 67 == 0, 2).when(k % 83 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("label") == 1, "Lesions").otherwise(healthy).alias("source_dataset"), F.concat(F.lit("s"), "source").alias("source_split"),
        F.when(k % 89 != 0, F.col("record_id")).alias("source_key"), "case_id", "z",
        F.array(F.lit(128), F.when(k % 79 == 0, 64).otherwise(128)).alias("model_shape"), F.when(k % 73 == 0, 2).otherwise(1).alias("copies"),
    )
    rows = staged(rows.withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).drop("_", "copies"))
    # The frozen counts are those of the manifest before the faults.
    frozen = paired.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    expected = frozen.select(F.concat(F.lit("split:"), "split").alias("measure"), "n").unionByName(
        frozen.agg(F.sum("n").alias("n")).select(F.lit("records").alias("measure"), "n")
    ).unionByName(paired.select("pair_id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("pairs").alias("measure"), "n"))
    return rules.validate_manifest(rows, (128, 128), ["lesions"], staged(expected))


@query("n5_manifest_validation", f"WITH {MANIFEST} SELECT rule, key FROM viol")
def manifest_validation(spark, d):
    return manifest_violations(spark, d)


@query("n5_manifest_report", f"WITH {MANIFEST} {report_sql(rules.MANIFEST_RULES)}")
def manifest_report(spark, d):
    return rules.report(manifest_violations(spark, d), rules.MANIFEST_RULES)


DIRECT = f"""{S.PAIRS}, healthy AS (SELECT 'healthy_' || source AS source_dataset, 's' || (z % 2) AS source_split, record_id, participant, case_id, z FROM records WHERE label = 0),
src AS (SELECT source_dataset, source_split, record_id AS source_id, participant, case_id, CASE WHEN case_id % 47 = 0 THEN z + 1 ELSE z END AS z, CASE WHEN case_id % 103 = 0 THEN 2 ELSE 1 END AS copies FROM healthy WHERE case_id % 41 <> 0)"""
GRID = f"""{DIRECT}, mix AS (SELECT source_split, 'm' || record_id AS local, source_dataset, record_id AS source_id, CASE WHEN case_id % 101 = 0 THEN 2 ELSE 1 END AS copies FROM healthy WHERE case_id % 31 <> 0),
gr AS MATERIALIZED (SELECT participant, record_id, pair_id, CASE WHEN source_key % 53 = 0 THEN 'test' ELSE split END AS split, label, z, CASE WHEN source_key % 43 = 0 THEN z_norm + 0.01 ELSE z_norm END AS z_norm, CASE WHEN source_key % 59 = 0 THEN z_bin + 1 ELSE z_bin END AS z_bin, case_id,
  support < 0.05 OR source_key % 37 = 0 AS thin, label = 1 AND (source_key % 67 = 0 OR source_key % 69 = 0 OR source_key % 77 = 0 OR case_id % 29 = 0) AS lesion_bad, 'healthy_' || source AS source_dataset, 's' || (z % 2) AS source_split, 'm' || record_id AS local FROM paired),
sm AS (SELECT participant, min(split) AS split, min(label) AS label FROM records JOIN split_map USING (participant) GROUP BY 1),
old AS (SELECT 'healthy' AS map, participant, CASE WHEN participant % 17 = 0 THEN 'val' ELSE split END AS split FROM sm WHERE label = 0 AND participant % 3 <> 0 UNION ALL SELECT 'lesion', participant, CASE WHEN participant % 19 = 0 THEN 'train' ELSE split END FROM sm WHERE label = 1 AND participant % 4 <> 0),
want AS (SELECT participant, CASE WHEN participant % 13 = 0 THEN 'test' ELSE split END AS split FROM sm WHERE label = 0 AND participant % 23 <> 0),
obs AS (SELECT DISTINCT participant, split, label FROM gr), one AS (SELECT participant, min(split) AS split, max(label) AS label FROM obs GROUP BY 1 HAVING count(DISTINCT split) = 1),
hist AS (SELECT pair_id, z_bin, count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label = 1) AS b FROM gr GROUP BY ALL), h AS (SELECT gr.*, mix.source_id FROM gr LEFT JOIN mix USING (source_split, local) WHERE label = 0),
viol AS MATERIALIZED (SELECT 'pair_histogram' AS rule, pair_id AS key FROM hist WHERE right(pair_id, 1) <> '0' GROUP BY pair_id HAVING bool_or(a <> b OR a > 2)
UNION ALL SELECT DISTINCT 'participant_overlap', x.split || '|' || y.split || ':' || x.participant FROM obs x JOIN obs y ON x.participant = y.participant AND x.split < y.split
UNION ALL SELECT 'z_norm', record_id FROM gr WHERE abs(z_norm - z / 6.0::DOUBLE) > 1e-12 UNION ALL SELECT 'support', record_id FROM gr WHERE thin UNION ALL SELECT 'zero_mask', record_id FROM gr WHERE lesion_bad
UNION ALL SELECT 'duplicate_source_key', concat_ws(':', source_dataset, source_split, source_id) FROM src WHERE copies > 1 UNION ALL SELECT 'duplicate_mixed_split_local_key', source_split || ':' || local FROM mix WHERE copies > 1
UNION ALL SELECT 'missing_mixed_split_local_key', record_id FROM h WHERE source_id IS NULL UNION ALL SELECT 'missing_underlying_source_key', record_id FROM h WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'mixed_underlying_metadata_mismatch', record_id FROM h JOIN src USING (source_dataset, source_split, source_id) WHERE (h.participant, h.case_id, h.z) <> (src.participant, src.case_id, src.z)
UNION ALL SELECT 'participant_has_multiple_output_splits', CAST(participant AS VARCHAR) FROM obs GROUP BY participant HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'healthy_map_changed', CAST(one.participant AS VARCHAR) FROM one JOIN old ON one.participant = old.participant AND map = 'healthy' AND one.split <> old.split
UNION ALL SELECT 'lesion_map_changed', CAST(p.participant AS VARCHAR) FROM (SELECT participant, list(DISTINCT split) AS s FROM obs GROUP BY 1 HAVING max(label) = 1) p JOIN old ON p.participant = old.participant AND map = 'lesion' AND p.s <> [old.split]
UNION ALL SELECT DISTINCT 'participant_not_in_expected_map', CAST(participant AS VARCHAR) FROM obs WHERE label = 0 AND participant NOT IN (SELECT participant FROM want)
UNION ALL SELECT 'expected_split_differs', CAST(p.participant AS VARCHAR) FROM (SELECT participant, list(DISTINCT split) AS s FROM obs WHERE label = 0 GROUP BY 1) p JOIN want USING (participant) WHERE p.s <> [want.split])"""


def source_rows(records):
    """Healthy records as the source tables know them: (source_dataset, source_split, record_id, participant, case_id, z)."""
    return records.where("label = 0").select(F.concat(F.lit("healthy_"), "source").alias("source_dataset"), F.concat(F.lit("s"), F.col("z") % 2).alias("source_split"), "record_id", "participant", "case_id", "z")


def repeated(rows, copies):
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), copies))).drop("_")


def source_index(rows):
    case = F.col("case_id")
    kept = rows.where(case % 41 != 0).select("source_dataset", "source_split", F.col("record_id").alias("source_key"), "participant", "case_id", F.when(case % 47 == 0, F.col("z") + 1).otherwise(F.col("z")).alias("z"))
    return repeated(kept, F.when(case % 103 == 0, 2).otherwise(1))


def grid_violations(spark, d):
    k, case, s, person = F.col("source_key"), F.col("case_id"), F.col("support"), F.col("participant")
    mapped = t.split_records(spark, d)
    rows = staged(t.paired_records(spark, d, mapped).select(
        "participant", "record_id", "pair_id", F.when(k % 53 == 0, "test").otherwise(F.col("split")).alias("split"), "label", "z",
        F.when(k % 43 == 0, F.col("z_norm") + 0.01).otherwise(F.col("z_norm")).alias("z_norm"), F.when(k % 59 == 0, F.col("z_bin") + 1).otherwise(F.col("z_bin")).alias("z_bin"), "case_id",
        F.when(k % 74 == 0, F.array(s, s)).otherwise(F.array(s, F.least(s * 1.5, F.lit(1.0)), F.when(k % 37 != 0, s))).alias("support"),
        F.when(k % 67 == 0, 5).otherwise(0).alias("native_voxels"), F.when(k % 69 == 0, 1).otherwise(0).alias("mask_voxels"), (k % 77 != 0).alias("native_checked"), F.lit(True).alias("mask_checked"),
        F.concat(F.lit("/seg/"), "case_id").alias("seg_path"), F.concat(F.lit("healthy_"), "source").alias("source_dataset"), F.concat(F.lit("s"), F.col("z") % 2).alias("source_split"), F.concat(F.lit("m"), "record_id").alias("source_key"),
    ))
    files = t.table(spark, d, "orders").where("o_orderkey % 29 <> 0").select(F.concat(F.lit("/seg/"), "o_orderkey").alias("path"))
    healthy = staged(source_rows(mapped))
    mixed = repeated(healthy.where(case % 31 != 0).select("source_split", F.concat(F.lit("m"), "record_id").alias("mixed_local_key"), "source_dataset", F.col("record_id").alias("source_key"), "case_id"), F.when(case % 101 == 0, 2).otherwise(1))
    frozen = staged(mapped.select("participant", "split", "label").distinct())
    maps = frozen.where((F.col("label") == 0) & (person % 3 != 0)).select(F.lit("healthy").alias("map"), "participant", F.when(person % 17 == 0, "val").otherwise(F.col("split")).alias("split")).unionByName(
        frozen.where((F.col("label") == 1) & (person % 4 != 0)).select(F.lit("lesion").alias("map"), "participant", F.when(person % 19 == 0, "train").otherwise(F.col("split")).alias("split")))
    expected = frozen.where((F.col("label") == 0) & (person % 23 != 0)).select("participant", F.when(person % 13 == 0, "test").otherwise(F.col("split")).alias("split"))
    summaries = rows.where("NOT endswith(pair_id, '0')").select("pair_id")
    return rules.grid_audit(rows, summaries, files, source_index(healthy), mixed, maps, expected, t.DEPTH, 0.05)


@query("n6_grid_audit", f"WITH {GRID} SELECT rule, key FROM viol")
def grid_audit(spark, d):
    return grid_violations(spark, d)


@query("n6_grid_report", f"WITH {GRID} {report_sql(rules.GRID_RULES)}")
def grid_report(spark, d):
    return rules.report(grid_violations(spark, d), rules.GRID_RULES)


@query("n6_source_joins", f"""WITH {DIRECT}, h AS (SELECT *, 'healthy_' || source AS dataset, 's' || (z % 2) AS part FROM paired WHERE label = 0)
SELECT 'missing_split_local_key' AS rule, record_id AS key FROM h WHERE record_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'metadata_mismatch', record_id FROM h JOIN src ON (dataset, part, record_id) = (source_dataset, source_split, source_id) WHERE (h.participant, h.case_id, h.z) <> (src.participant, src.case_id, src.z)
UNION ALL SELECT 'duplicate_source_key', concat_ws(':', source_dataset, source_split, source_id) FROM src WHERE copies > 1""")
def direct_source_joins(spark, d):
    mapped = t.split_records(spark, d)
    rows = t.paired_records(spark, d, mapped).withColumns({"source_dataset": F.concat(F.lit("healthy_"), "source"), "source_split": F.concat(F.lit("s"), F.col("z") % 2), "source_key": F.col("record_id")})
    return rules.source_joins(rows, source_index(source_rows(mapped)))


@query("n18_inventory_audit", f"""WITH {S.RECORDS}, fc AS (SELECT participant, min(case_id) AS case_id FROM records WHERE label = 1 GROUP BY 1),
c AS (SELECT participant, z FROM records JOIN fc USING (participant, case_id) WHERE NOT (participant % 43 = 0 AND z = 1) UNION ALL SELECT participant, z FROM records JOIN fc USING (participant, case_id) WHERE participant % 37 = 0 AND z = 0),
inv AS (SELECT participant, count(DISTINCT l_linenumber) + CASE WHEN participant % 83 = 0 THEN 1 ELSE 0 END AS n FROM fc JOIN lineitem ON l_orderkey = case_id WHERE participant % 89 <> 0 GROUP BY 1),
led AS (SELECT participant FROM fc WHERE participant % 31 <> 0 UNION ALL SELECT participant FROM fc WHERE participant % 29 = 0 AND participant % 31 <> 0), k AS (SELECT participant, count(*) AS n FROM c GROUP BY 1),
au AS (SELECT source, bool_and(NOT (source_key % 43 = 0 AND source = 1)) AS good FROM records WHERE source <> 3 GROUP BY 1)
SELECT 'duplicate_candidate_participant_z' AS rule, participant || ':' || z AS key FROM c GROUP BY participant, z HAVING count(*) > 1
UNION ALL SELECT 'candidate_rows_do_not_match_support_counts', CAST(coalesce(k.participant, inv.participant) AS VARCHAR) FROM k FULL JOIN inv ON k.participant = inv.participant WHERE k.n IS DISTINCT FROM inv.n
UNION ALL SELECT 'candidate_row_count_mismatch', a || ':' || b FROM (SELECT (SELECT count(*) FROM c) AS a, (SELECT sum(n) FROM inv)::BIGINT AS b) WHERE a <> b
UNION ALL SELECT 'ledger_subject_repeated', CAST(participant AS VARCHAR) FROM led GROUP BY participant HAVING count(*) > 1 UNION ALL SELECT 'ledger_subject_missing', CAST(participant AS VARCHAR) FROM inv WHERE participant NOT IN (SELECT participant FROM led)
UNION ALL SELECT DISTINCT 'ledger_subject_unknown', CAST(participant AS VARCHAR) FROM led WHERE participant NOT IN (SELECT participant FROM inv)
UNION ALL SELECT 'audit_not_pass', CAST(s AS VARCHAR) FROM range(5) r(s) LEFT JOIN au ON source = s WHERE good IS NOT TRUE UNION ALL SELECT 'tensor_parity_fail', CAST(source AS VARCHAR) FROM au WHERE source = 2""")
def inventory_audit(spark, d):
    rows = staged(t.records(spark, d).select("participant", "case_id", "z", "label", "source", "source_key"))
    person = F.col("participant")
    first = staged(rows.where("label = 1").groupBy("participant").agg(F.min("case_id").alias("case_id")))
    own = rows.select("participant", "case_id", "z").join(first, ["participant", "case_id"])
    candidates = repeated(own.where(~((person % 43 == 0) & (F.col("z") == 1))), F.when((person % 37 == 0) & (F.col("z") == 0), 2).otherwise(1))
    lines = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    inventory = first.where(person % 89 != 0).join(lines, "case_id").select(person.alias("subject"), (F.col("n") + F.when(person % 83 == 0, 1).otherwise(0)).alias("support_slices"))
    ledger = repeated(first.where(person % 31 != 0).select(person.alias("subject"), "participant"), F.when(person % 29 == 0, 2).otherwise(1))
    good = F.bool_and(~((F.col("source_key") % 43 == 0) & (F.col("source") == 1)))
    status = rows.where("source <> 3").groupBy(F.col("source").cast("string").alias("comparison")).agg(F.when(good, "PASS").otherwise("FAIL").alias("status"))
    parity = F.when(F.col("comparison") == "2", "FAIL").otherwise("NOT_APPLICABLE")
    checks = status.select("comparison", F.explode(F.array(F.struct(F.lit("status").alias("check"), "status"), F.struct(F.lit("tensor_parity").alias("check"), parity.alias("status")))).alias("_c")).select("comparison", "_c.check", "_c.status")
    return rules.inventory_audit(candidates.withColumn("subject", person), inventory, ledger, checks, [str(i) for i in range(5)])


RELEASE_SPLIT = "CASE WHEN c_custkey % 5 = 0 THEN 'val' ELSE 'train' END"


@query("p18_release_findings", f"""WITH r AS (SELECT c_custkey AS id, {RELEASE_SPLIT} AS split FROM customer), c AS (SELECT c_custkey + CASE WHEN c_custkey % 209 = 0 THEN 10000000 ELSE 0 END AS id FROM customer WHERE c_custkey % 19 = 0),
q AS (SELECT c_custkey AS id, c_custkey % 19 = 0 AND c_custkey % 7 <> 0 OR c_custkey % 101 = 0 AS ex FROM customer WHERE c_custkey % 133 <> 0), k AS (SELECT split, count(*) AS n FROM r WHERE id NOT IN (SELECT id FROM c) GROUP BY 1)
SELECT 'configured_absent_from_source' AS rule, CAST(id AS VARCHAR) AS key FROM c WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'configured_only', CAST(id AS VARCHAR) FROM c WHERE id NOT IN (SELECT id FROM q WHERE ex)
UNION ALL SELECT 'adjudicated_only', CAST(id AS VARCHAR) FROM q WHERE ex AND id NOT IN (SELECT id FROM c) UNION ALL SELECT 'absent_from_review_queue', CAST(id AS VARCHAR) FROM c WHERE id NOT IN (SELECT id FROM q)
UNION ALL SELECT 'split_count_differs', k.split FROM k JOIN (SELECT split, count(*) FILTER (WHERE id % 19 <> 0) AS n FROM r GROUP BY 1) w USING (split) WHERE k.n <> w.n""")
def release_findings(spark, d):
    k = F.col("c_custkey")
    people = t.table(spark, d, "customer").select("c_custkey")
    records = people.select(k.alias("id"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"))
    configured = people.where(k % 19 == 0).select((k + F.when(k % 209 == 0, 10000000).otherwise(0)).alias("id"))
    review = people.where(k % 133 != 0).select(k.alias("id"), F.when(((k % 19 == 0) & (k % 7 != 0)) | (k % 101 == 0), "EXCLUDE").otherwise("KEEP").alias("manual_status"))
    per_split = records.where("id % 19 <> 0").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return rules.release_findings(records, "id", configured, review, per_split=per_split)
