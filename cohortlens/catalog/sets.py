"""Checked joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import sets
from cohortlens.operators.scale import parallelism
from cohortlens.plans import tables as t

SLICES = """sl AS (SELECT l_orderkey AS case_id, l_linenumber - 1 AS z FROM lineitem), se AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'EXCLUDED' ELSE 'PASS' END AS status FROM orders)"""


def slices(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") - 1).alias("z"))


def sessions(spark, d):
    return t.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "EXCLUDED").otherwise("PASS").alias("status"))


@query("j2_slices_against_sessions", f"""WITH {SLICES} SELECT 'case_not_pass' AS rule, CAST(case_id AS VARCHAR) AS key FROM (SELECT DISTINCT case_id FROM sl) WHERE case_id NOT IN (SELECT case_id FROM se WHERE status = 'PASS')
UNION ALL SELECT 'pass_without_slices', CAST(case_id AS VARCHAR) FROM se WHERE status = 'PASS' AND case_id NOT IN (SELECT case_id FROM sl)
UNION ALL SELECT 'duplicate_slice', case_id || ':' || z FROM sl GROUP BY case_id, z HAVING count(*) > 1""")
def slices_against_sessions(spark, d):
    return sets.slices_against_sessions(slices(spark, d), sessions(spark, d))


MANIFEST = f"""{S.RECORDS}, mf AS (SELECT record_id, participant, case_id, label FROM records WHERE source_key % 29 <> 0),
pr AS (SELECT record_id, CASE WHEN source_key % 31 = 0 THEN participant + 1 ELSE participant END AS participant, case_id, CASE WHEN source_key % 37 = 0 THEN 1 - label ELSE label END AS label,
 {S.probability("'1'")} * CASE WHEN source_key % 41 = 0 THEN 2 ELSE 1 END AS p FROM records WHERE source_key % 23 <> 0)"""


@query("j3_manifest_against_predictions", f"""WITH {MANIFEST}, j AS (SELECT coalesce(m.record_id, p.record_id) AS record_id, list_filter([CASE WHEN m.record_id IS NULL THEN 'not_in_manifest' END, CASE WHEN p.record_id IS NULL THEN 'no_prediction' END,
 CASE WHEN m.participant <> p.participant THEN 'participant_differs' END, CASE WHEN m.case_id <> p.case_id THEN 'case_id_differs' END, CASE WHEN m.label <> p.label THEN 'label_differs' END,
 CASE WHEN m.record_id IS NOT NULL AND NOT p.p BETWEEN 0 AND 1 THEN 'bad_probability' END], lambda x: x IS NOT NULL) AS problems FROM mf m FULL JOIN pr p ON m.record_id = p.record_id)
SELECT record_id, problems FROM j WHERE len(problems) > 0""")
def manifest_against_predictions(spark, d):
    rows = t.records(spark, d)
    m = rows.where("source_key % 29 <> 0").select("record_id", "participant", "case_id", "label")
    p = rows.where("source_key % 23 <> 0").select(
        "record_id", F.when(F.col("source_key") % 31 == 0, F.col("participant") + 1).otherwise(F.col("participant")).alias("participant"), "case_id",
        F.when(F.col("source_key") % 37 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        (t.probability("1", "record_id", F.col("label")) * F.when(F.col("source_key") % 41 == 0, 2).otherwise(1)).alias("p"))
    return sets.manifest_against_predictions(m, p, "record_id", ["participant", "case_id"], "label", "p")


@query("j4_split_local_join", f"""WITH {S.SPLITS}, so AS (SELECT DISTINCT split, source_key, split || '/' || source_key AS path FROM records JOIN split_map USING (participant))
SELECT record_id, r.split, path FROM (SELECT r.*, split FROM records r JOIN split_map USING (participant)) r LEFT JOIN so ON so.split = r.split AND so.source_key = r.source_key""")
def split_local_join(spark, d):
    mapped = t.split_records(spark, d)
    source = mapped.select("split", "source_key").distinct().withColumn("path", F.concat_ws("/", "split", "source_key"))
    joined, repeated = sets.keyed_join(mapped, source, ["split", "source_key"])
    return joined.join(repeated, ["split", "source_key"], "left_anti").select("record_id", "split", "path")


@query("j5_fallback_join", f"""WITH {S.RECORDS}, a AS (SELECT DISTINCT record_id, 'exact' AS v FROM records WHERE source_key % 3 = 0), b AS (SELECT participant, case_id, min(stage) AS v FROM records WHERE source_key % 3 = 1 GROUP BY ALL),
c AS (SELECT participant, CASE WHEN min(site) = max(site) THEN min(site) END AS v FROM records GROUP BY participant)
SELECT r.record_id, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 WHEN c.v IS NOT NULL THEN 2 END AS matched_by, false AS conflict
FROM records r LEFT JOIN a USING (record_id) LEFT JOIN b ON r.participant = b.participant AND r.case_id = b.case_id LEFT JOIN c ON c.participant = r.participant""")
def fallback_join(spark, d):
    rows = t.records(spark, d)
    exact = rows.where("source_key % 3 = 0").select("record_id", F.lit("exact").alias("v"))
    session = rows.where("source_key % 3 = 1").select("participant", "case_id", F.col("stage").alias("v"))
    person = rows.select("participant", F.col("site").alias("v"))
    out = sets.fallback_join(rows.select("record_id", "participant", "case_id"), [(["record_id"], exact), (["participant", "case_id"], session), (["participant"], person)], "v")
    return out.select("record_id", "v", "matched_by", "conflict")


@query("j6_hash_ledger", f"""WITH {S.RECORDS}, r AS (SELECT participant, case_id, z, sha256(participant || '|' || case_id || '|' || z || CASE WHEN source_key % 19 = 0 THEN 'x' ELSE '' END) AS h, source_key FROM records),
l AS (SELECT participant, case_id, z, sha256(participant || '|' || case_id || '|' || z) AS w FROM records WHERE source_key % 17 <> 0), m AS (SELECT DISTINCT case_id FROM records WHERE z < 5),
j AS (SELECT r.participant, r.case_id, r.z, CASE WHEN w IS NULL THEN 'not_in_ledger' WHEN w <> h THEN 'digest_differs' WHEN m.case_id IS NULL THEN 'outside_scope' END AS problem
 FROM r LEFT JOIN l ON l.participant = r.participant AND l.case_id = r.case_id AND l.z = r.z LEFT JOIN m ON m.case_id = r.case_id) SELECT * FROM j WHERE problem IS NOT NULL""")
def hash_ledger(spark, d):
    rows = t.records(spark, d)
    text = F.concat_ws("|", "participant", "case_id", "z")
    tampered = F.concat(text, F.when(F.col("source_key") % 19 == 0, "x").otherwise(""))
    mine = rows.select("participant", "case_id", "z", F.sha2(tampered, 256).alias("h"))
    ledger = rows.where("source_key % 17 <> 0").select("participant", "case_id", "z", F.sha2(text, 256).alias("h"))
    return sets.against_ledger(mine, ledger, ["participant", "case_id", "z"], "h", rows.where("z < 5").select("case_id"), ["case_id"])


@query("j7_runs_with_controls", """WITH r AS (SELECT lower(trim(c_mktsegment)) AS cohort, n_regionkey AS model, count(*) AS subjects, round(avg(c_acctbal), 6) AS auc FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
k AS (SELECT lower(p_type) AS t, p_size % 5 AS model, min(p_retailprice) AS low FROM part GROUP BY ALL), s AS (SELECT model, min(low) AS control FROM k GROUP BY model HAVING model < 4)
SELECT cohort, r.model, subjects, auc, control, control IS NOT NULL AS has_control FROM r LEFT JOIN s ON r.model = s.model""")
def runs_with_controls(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    runs = c.groupBy(F.lower(F.trim("c_mktsegment")).alias("cohort"), F.col("n_regionkey").alias("model")).agg(F.count(F.lit(1)).alias("subjects"), F.round(F.avg("c_acctbal"), 6).alias("auc"))
    controls = t.table(spark, d, "part").groupBy((F.col("p_size") % 5).alias("model")).agg(F.min("p_retailprice").alias("control")).where("model < 4")
    return runs.join(controls, "model", "left").withColumn("has_control", F.col("control").isNotNull())


@query("j8_one_row_per_domain", f"""WITH {S.RECORDS}, a AS (SELECT source, round(avg(support), 9) AS auc FROM records GROUP BY source), b AS (SELECT source, round(avg(label), 9) AS ap FROM records GROUP BY source) SELECT source, auc, ap FROM a JOIN b USING (source)""")
def one_per_domain(spark, d):
    rows = t.records(spark, d)
    a = rows.groupBy("source").agg(F.round(F.avg("support"), 9).alias("auc"))
    b = rows.groupBy("source").agg(F.round(F.avg("label"), 9).alias("ap"))
    return sets.one_per_key(a, b, "source", [0, 1, 2, 3, 4])


VERSIONS = """v AS (SELECT l_linestatus AS model, l_linenumber AS metric, round(avg(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem GROUP BY ALL)"""


@query("j9_compare_versions", f"""WITH {VERSIONS} SELECT a.metric, a.value AS a, b.value AS b, round(b.value - a.value, 4) AS difference, round(100.0 * (b.value - a.value) / abs(a.value), 6) AS relative_percent,
 CASE WHEN abs(b.value - a.value) <= 1e-12 THEN 'tie' WHEN b.value > a.value THEN 'b' ELSE 'a' END AS winner FROM v a JOIN v b ON a.metric = b.metric AND a.model = 'F' AND b.model = 'O'""")
def compare_versions(spark, d):
    v = t.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("metric")).agg(F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))
    out = sets.compare_versions(v.where("model = 'F'"), v.where("model = 'O'"), ["metric"], "value")
    return out.withColumns({"difference": F.round("difference", 4), "relative_percent": F.round("relative_percent", 6)})


@query("j10_learning_curve_join", """WITH c AS (SELECT o_orderstatus AS run, CAST(year(o_orderdate) AS INTEGER) AS epoch, avg(o_totalprice) AS loss FROM orders GROUP BY ALL)
SELECT a.epoch, round(a.loss, 4) AS loss_a, round(b.loss, 4) AS loss_b FROM c a JOIN c b ON a.epoch = b.epoch AND a.run = 'F' AND b.run = 'O'""")
def curve_join(spark, d):
    c = t.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("run"), F.year("o_orderdate").alias("epoch")).agg(F.avg("o_totalprice").alias("loss"))
    a = c.where("run = 'F'").select("epoch", F.round("loss", 4).alias("loss_a"))
    return a.join(c.where("run = 'O'").select("epoch", F.round("loss", 4).alias("loss_b")), "epoch")


@query("j12_one_to_many", f"""WITH {S.RECORDS}, f AS (SELECT case_id, count(*) AS slices, round(avg(support), 9) AS mean_support FROM records GROUP BY case_id) SELECT r.record_id, case_id, slices, mean_support FROM f JOIN records r USING (case_id)""")
def one_to_many(spark, d):
    # Dealt once by case for both sides, in shares that adaptive execution does not merge.
    rows = t.records(spark, d).select("case_id", "record_id", "support").repartition(4 * parallelism(spark), "case_id")
    features = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("slices"), F.round(F.avg("support"), 9).alias("mean_support"))
    return sets.one_to_many(features, rows.select("case_id", "record_id"), ["case_id"])


@query("j13_against_baseline", """WITH v AS (SELECT l_suppkey AS key, l_returnflag AS variant, avg(l_discount) AS p, avg(l_tax) AS logit FROM lineitem GROUP BY ALL)
SELECT v.key, v.variant, round(v.p - b.p, 9) AS delta_p, round(v.logit - b.logit, 9) AS delta_logit FROM v LEFT JOIN v b ON v.key = b.key AND b.variant = 'N'""")
def against_baseline(spark, d):
    v = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("variant")).agg(F.avg("l_discount").alias("p"), F.avg("l_tax").alias("logit"))
    out = sets.against_baseline(v, ["key"], "variant", "N", ["p", "logit"])
    return out.select("key", "variant", F.round("delta_p", 9).alias("delta_p"), F.round("delta_logit", 9).alias("delta_logit"))


@query("j14_source_intersection", """SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def source_intersection(spark, d):
    orders = t.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    first = t.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return sets.intersect_sources(first, [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'")], "id")


@query("u1_union_with_duplicates", """WITH u AS (SELECT c_custkey AS id, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey * 7, 'supplier' FROM supplier UNION ALL SELECT p_partkey + 900, 'part' FROM part)
SELECT id, count(*) AS copies, list_sort(list(DISTINCT source)) AS sources FROM u GROUP BY id HAVING count(*) > 1""")
def union_with_duplicates(spark, d):
    return sets.union_cohorts({
        "customer": t.table(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        "supplier": t.table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("id")),
        "part": t.table(spark, d, "part").select((F.col("p_partkey") + 900).alias("id")),
    }, "id")[1]


@query("u2_split_overlap", """WITH s AS (SELECT DISTINCT o_custkey AS id, o_orderstatus AS split FROM orders)
SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM s a JOIN s b ON a.id = b.id AND a.split < b.split GROUP BY ALL""")
def split_overlap(spark, d):
    return sets.split_overlap(t.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("split")), "id")


@query("u3_all_minus_validation", """SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def minus_validation(spark, d):
    everyone = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return sets.without(everyone, t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id")


MULTI = """e AS (SELECT l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem), o AS (SELECT l_suppkey, l_linenumber, CAST(CASE WHEN l_partkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS INTEGER) AS q FROM lineitem WHERE l_partkey % 89 <> 0)"""


def replayed(spark, d):
    lines = t.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    e = lines.select("l_suppkey", "l_linenumber", q.alias("q"))
    o = lines.where("l_partkey % 89 <> 0").select("l_suppkey", "l_linenumber", (q + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)).alias("q"))
    return e, o


@query("u4_multiset_difference", f"""WITH {MULTI}, n AS (SELECT l_suppkey, l_linenumber, q, sum(d) AS d FROM (SELECT *, 1 AS d FROM e UNION ALL SELECT *, -1 FROM o) GROUP BY ALL)
SELECT l_suppkey, l_linenumber, q, CASE WHEN d > 0 THEN 'missing' ELSE 'extra' END AS side, CAST(abs(d) AS BIGINT) AS copies FROM n WHERE d <> 0""")
def multiset_difference(spark, d):
    e, o = replayed(spark, d)
    return sets.multiset_difference(e, o, ["l_suppkey", "l_linenumber", "q"])


@query("u4_field_mismatches", f"""WITH {S.RECORDS} SELECT 'support' AS field, count(*) FILTER (WHERE source_key % 13 = 0) AS mismatches FROM records UNION ALL SELECT 'stage', count(*) FILTER (WHERE source_key % 11 = 0) FROM records""")
def field_mismatches(spark, d):
    rows = t.records(spark, d).select("participant", "case_id", "z", "source_key", "support", "stage")
    changed = rows.withColumns({
        "support": F.when(F.col("source_key") % 13 == 0, F.col("support") + 1).otherwise(F.col("support")),
        "stage": F.when(F.col("source_key") % 11 == 0, F.lit("changed")).otherwise(F.col("stage")),
    })
    return sets.field_mismatches(rows, changed, ["participant", "case_id", "z"], ["support", "stage"])


@query("u5_full_row_comparison", f"""WITH {S.RECORDS}, a AS (SELECT participant, z, '{{"site":"' || site || '","stage":"' || stage || '"}}' AS m FROM records),
b AS (SELECT participant, z, '{{"site":"' || site || '","stage":"' || CASE WHEN source_key % 53 = 0 THEN 'changed' ELSE stage END || '"}}' AS m FROM records),
n AS (SELECT participant, z, m, sum(d) AS d FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL) SELECT participant, z, m, CASE WHEN d > 0 THEN 'missing' ELSE 'extra' END AS side, CAST(abs(d) AS BIGINT) AS copies FROM n WHERE d <> 0""")
def full_row_comparison(spark, d):
    from cohortlens.functions import scalars

    # Dealt once for both sides: the counts of one task stay a small share of all rows.
    rows = t.records(spark, d).select("participant", "z", "site", "stage", "source_key").repartition(4 * parallelism(spark), "participant", "z")

    def canonical(stage):
        entries = F.create_map(F.lit("stage"), stage, F.lit("site"), F.col("site"))
        return rows.select("participant", "z", entries.alias("e")).select("participant", "z", scalars.sorted_map_json("e").alias("m"))

    changed = F.when(F.col("source_key") % 53 == 0, "changed").otherwise(F.col("stage"))
    return sets.multiset_difference(canonical(F.col("stage")), canonical(changed), ["participant", "z", "m"])


@query("u6_symmetric_difference", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount > 0.09), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax > 0.07)
SELECT id, 'configured_only' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'adjudicated_only' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def symmetric_difference(spark, d):
    lines = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_discount", "l_tax")
    return sets.symmetric_difference(lines.where("l_discount > 0.09"), lines.where("l_tax > 0.07"), "id")


@query("u7_common_pass", """SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def common_pass(spark, d):
    orders = t.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    parts = [orders.where(F.col("o_orderstatus") == s).select("id") for s in ("F", "O", "P")]
    return parts[0].intersect(parts[1]).intersect(parts[2])


@query("u8_plan_coverage", """WITH p AS (SELECT DISTINCT c_mktsegment AS cohort, n_regionkey AS model FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'),
o AS (SELECT c_mktsegment AS cohort, n_regionkey AS model, count(*) AS results FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 GROUP BY ALL)
SELECT coalesce(p.cohort, o.cohort) AS cohort, coalesce(p.model, o.model) AS model, coalesce(results, 0) AS results, CASE WHEN p.cohort IS NULL THEN 'unplanned' WHEN results IS NULL THEN 'missing' WHEN results > 1 THEN 'duplicate' ELSE 'complete' END AS status
FROM p FULL JOIN o ON p.cohort = o.cohort AND p.model = o.model""")
def plan_coverage(spark, d):
    c = t.table(spark, d, "customer").join(t.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = c.select(F.col("c_mktsegment").alias("cohort"), F.col("n_regionkey").alias("model"), "c_acctbal")
    return sets.plan_coverage(cells.where("cohort <> 'BUILDING'").select("cohort", "model").distinct(), cells.where("c_acctbal > 9500"), ["cohort", "model"])
