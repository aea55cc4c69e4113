"""Projections, predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.functions import digests, scalars
from cohortlens.operators import configs
from cohortlens.operators.scale import attach_scalar
from cohortlens.plans import tables as t


@query("p1_sanitize", """SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 OR value IS NULL THEN 0 ELSE CAST(value AS FLOAT) END AS DOUBLE) AS score FROM events""")
def sanitize(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return t.table(spark, d, "events").select("event_id", scalars.sanitize(raw).cast("double").alias("score"))


@query("p2_fixed_mask", f"WITH {S.TIED} SELECT subject, z, count(*) FILTER (WHERE score > 0.07::FLOAT) AS masked, count(*) AS n FROM tied GROUP BY subject, z")
def fixed_mask(spark, d):
    hit = scalars.above("score", 0.07)
    return t.elements(spark, d, "l_discount").groupBy("subject", "z").agg(F.count_if(hit).alias("masked"), F.count(F.lit(1)).alias("n"))


@query("p3_mask_label", "SELECT l_suppkey AS subject, count(*) FILTER (WHERE l_tax > 0) AS positive_zero, count(*) FILTER (WHERE l_tax > 0.05) AS positive_half FROM lineitem GROUP BY 1")
def mask_label(spark, d):
    return t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject")).agg(
        F.count_if(scalars.mask_label("l_tax")).alias("positive_zero"), F.count_if(scalars.mask_label("l_tax", 0.05)).alias("positive_half"))


@query("p4_healthy_slices", "SELECT l_suppkey AS subject, l_linenumber AS z FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_quantity <> 0) AND NOT bool_or(l_discount >= 0.1)")
def healthy_slices(spark, d):
    flags = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("z")).agg(
        F.bool_or(F.col("l_quantity") != 0).alias("fg"), F.bool_or(F.col("l_discount") >= 0.1).alias("lesion"))
    return flags.where("fg AND NOT lesion").select("subject", "z")


@query("p5_label_aliases", """WITH x AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN ' Healthy' WHEN 1 THEN 'LESION' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN 'target ' WHEN 5 THEN 'true' WHEN 6 THEN 'b' ELSE p_brand END AS raw, p_size % 8 AS k FROM part)
SELECT p_partkey, raw, CAST(CASE WHEN k = 0 THEN 0 WHEN k IN (1, 2, 4, 6) THEN 1 END AS INTEGER) AS label, CAST(CASE WHEN k = 0 THEN 0 WHEN k IN (1, 2, 4, 6) THEN 1 ELSE k % 2 END AS INTEGER) AS checked,
 CAST(k % 2 AS INTEGER) AS by_type FROM x""")
def label_aliases(spark, d):
    words = F.array(*[F.lit(w) for w in (" Healthy", "LESION", "1", "0.0", "target ", "true", "b")])
    part = t.table(spark, d, "part").withColumn("raw", F.coalesce(F.get(words, F.col("p_size") % 8), F.col("p_brand")))
    odd = F.col("p_size") % 2
    # The failing form sees the rows that have a label; the others get a number, read by its type like the boolean.
    checked = F.when(scalars.label_or_null("raw").isNotNull(), scalars.label_strict("raw")).otherwise(scalars.label_strict(odd))
    return part.select("p_partkey", "raw", scalars.label_or_null("raw").alias("label"), checked.alias("checked"), scalars.label_strict(odd == 1).alias("by_type"))


@query("p6_z_norm", "SELECT l_orderkey, l_linenumber, max((l_linenumber - 1) / 6.0::DOUBLE) AS z_norm FROM lineitem GROUP BY 1, 2")
def z_norm(spark, d):
    norm = scalars.z_norm(F.col("l_linenumber") - 1, F.lit(7))
    checked = scalars.fail_unless(norm.between(0, 1), norm, "z_norm outside [0, 1]")
    return t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(checked).alias("z_norm"))


@query("p7_z_bin", "SELECT CAST(least(9, floor((l_quantity - 1) / 49 * 10)) AS INTEGER) AS z_bin, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def z_bin(spark, d):
    return t.table(spark, d, "lineitem").groupBy(scalars.z_bin((F.col("l_quantity") - 1) / 49, 10).alias("z_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("p8_namespaced_id", "SELECT doc_id, lower(replace(source || '/' || lang, '/', '_')) || ':' || doc_id AS id FROM documents")
def namespaced_id(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scalars.namespaced_id(F.concat_ws("/", "source", "lang"), "doc_id").alias("id"))


@query("p9_support_gate", """WITH f AS (SELECT l_suppkey AS subject, l_linenumber AS z, [avg(CAST(l_discount > 0 AS INTEGER)), avg(CAST(l_tax > 0 AS INTEGER)), avg(CAST(l_quantity > 5 AS INTEGER))] AS fractions FROM lineitem GROUP BY 1, 2)
SELECT subject, z, list_min(fractions) >= 0.85 AS keep, CASE WHEN list_min(fractions) < 0.85 THEN 'support_below_threshold' END AS reason FROM f""")
def support_gate(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    f = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("z")).agg(
        F.array(share(F.col("l_discount") > 0), share(F.col("l_tax") > 0), share(F.col("l_quantity") > 5)).alias("fractions"))
    keep = F.forall("fractions", lambda v: v >= 0.85)
    return f.select("subject", "z", keep.alias("keep"), F.when(~keep, "support_below_threshold").alias("reason"))


@query("p11_modality_projection", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS flair, CAST(embedding[3] AS DOUBLE) AS t2 FROM embeddings")
def modality_projection(spark, d):
    # Named channels of a multi-channel row, reduced to a subset by position.
    channels = ("FLAIR", "T1", "T2")
    wanted = [channels.index(m) for m in ("FLAIR", "T2")]
    px = t.table(spark, d, "embeddings").select("vec_id", F.transform(F.array(*[F.lit(i) for i in wanted]), lambda i: F.get("embedding", i).cast("double")).alias("c"))
    return px.select("vec_id", F.get("c", F.lit(0)).alias("flair"), F.get("c", F.lit(1)).alias("t2"))


@query("p12_final_results", """SELECT page_id, url FROM pages WHERE lower(url) LIKE 'https%' AND NOT regexp_matches(lower(url), '(control|permut|shuffle|page=)')""")
def final_results(spark, d):
    url = F.lower("url")
    return t.table(spark, d, "pages").where(url.startswith("https") & ~url.rlike("(control|permut|shuffle|page=)")).select("page_id", "url")


@query("p12_result_contract", """WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'Final ' WHEN 2 THEN 'final' WHEN 3 THEN 'registered' END AS stage FROM part),
y AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'diagnostic_formalfit' WHEN stage IN ('raw', 'registered') THEN 'intermediate' WHEN k % 13 = 2 OR k % 7 IN (0, 3) OR k % 11 = 0 OR k % 6 IN (0, 2) THEN 'control' ELSE 'formal_final' END AS kind,
 stage IS NOT NULL AND lower(trim(stage)) = 'final' AND k % 3 < 2 AND k % 2 = 0 AND k % 4 < 3 AS primary_row FROM x)
SELECT k AS run, kind, primary_row, primary_row AND kind = 'formal_final' AS selected FROM y""")
def result_contract(spark, d):
    k = F.col("p_partkey")

    def pick(n, *values):
        return F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))

    stage = pick(5, "raw", "Final ", "final", "registered")
    kind = pick(13, "diagnostic_fit", "formal_final", "negative control")
    markers = {"is_control": pick(7, "yes", "no", "main", "swap"), "permutation_index": F.when(k % 11 == 0, "3"), "purpose": F.lit("domain_classifier nullable")}
    path = F.concat(F.lit("/runs/domain_classifier/"), F.coalesce(pick(6, "tiny_overfit", "controlled", "Null-run"), F.lit("main")), F.lit("/summary.csv"))
    selector = {"stage": "final", "modalities": "FLAIR+T1+T2", "classifier": "resnet", "seed": 73}
    primary = scalars.is_primary(stage, pick(3, "T2, flair,t1", "FLAIR+T1+T2", "t1"), pick(2, "ResNet ", "logistic"), pick(4, "73", "73", "73", "74"), selector)
    rows = t.table(spark, d, "part").select(k.alias("run"), scalars.result_kind(kind, stage, markers, [path]).alias("kind"), primary.alias("primary_row"))
    return rows.withColumn("selected", F.col("primary_row") & (F.col("kind") == "formal_final"))


@query("p13_text_normalizers", """WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 't2, flair' WHEN 1 THEN 'T1+FLAIR/T1' WHEN 2 THEN 'adc;t1' ELSE 't2' END AS m, CASE p_size % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'No' ELSE 'n/a' END AS s, p_size % 4 AS k, p_size % 3 AS j FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'FLAIR+T2' WHEN 1 THEN 'FLAIR+T1' WHEN 2 THEN 'T1+ADC' ELSE 'T2' END AS modalities, CASE j WHEN 0 THEN true WHEN 1 THEN false END AS passed FROM x""")
def text_normalizers(spark, d):
    m = F.get(F.array(*[F.lit(v) for v in ("t2, flair", "T1+FLAIR/T1", "adc;t1", "t2")]), F.col("p_size") % 4)
    s = F.get(F.array(*[F.lit(v) for v in ("passed", "No", "n/a")]), F.col("p_size") % 3)
    return t.table(spark, d, "part").select("p_partkey", scalars.modality_set(m).alias("modalities"), scalars.tri_state(s).alias("passed"))


@query("p14_first_present", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN p_name END, p_brand) AS value FROM part""")
def first_present(spark, d):
    a = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("  ")
    b = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    return t.table(spark, d, "part").select("p_partkey", scalars.first_present(a, b, "p_brand").alias("value"))


@query("p15_safe_id", r"""SELECT page_id, CASE WHEN url = '' THEN 'subject' ELSE regexp_replace(url, '[^\p{L}\p{N}\-_.]', '_', 'g') END AS id FROM pages""")
def safe_id(spark, d):
    return t.table(spark, d, "pages").select("page_id", scalars.safe_id("url").alias("id"))


@query("p16_truthy", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag FROM events""")
def truthy(spark, d):
    word = F.when(F.col("event_id") % 4 == 0, " Yes").when(F.col("event_id") % 4 == 1, "off").when(F.col("event_id") % 4 == 3, "")
    return t.table(spark, d, "events").select("event_id", scalars.truthy(word).alias("flag"))


NAMES = ("scan_FLAIR.nii.gz", "sub-1_T1w.nii.gz", "sub_t1ce.nii.gz", "sub_t2.nii", "sub_t1_post.nii.gz", "brainmask_t1.nii.gz", "x_T1n.nii.gz")


@query("g1_modality_from_name", """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'flair' WHEN 1 THEN 't1' WHEN 3 THEN 't2' WHEN 6 THEN 't1' END AS modality FROM part""")
def modality_from_name(spark, d):
    name = F.concat(F.regexp_replace("p_name", "[^a-z]", "-"), F.lit("_"), F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("p_size") % 7))
    return t.table(spark, d, "part").select("p_partkey", scalars.modality_from_name(name).alias("modality"))


@query("g2_strip_suffix", """SELECT p_partkey, p_name AS stem FROM part""")
def strip_suffix(spark, d):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".nii.gz").otherwise(".NII"))
    return t.table(spark, d, "part").select("p_partkey", scalars.strip_volume_suffix(name).alias("stem"))


@query("g3_subject_from_folder", r"""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*(\d+)$', 2) AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'FU001d' ELSE '' END AS follow_up FROM customer""")
def subject_from_folder(spark, d):
    folder = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_FU001d").otherwise(""), F.lit("_nifti"))
    pattern = r"^[A-Za-z]+#0*(\d+)(?:_(FU\d+d))?_nifti$"
    return t.table(spark, d, "customer").select("c_custkey", F.regexp_extract(folder, pattern, 1).alias("subject"), F.regexp_extract(folder, pattern, 2).alias("follow_up"))


@query("g3_naming_schemes", r"""WITH n AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '_FU001d' ELSE '' END AS stem FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN stem END AS stem, split_part(stem, '_', 1) AS subject FROM n""")
def naming_schemes(spark, d):
    k = F.col("c_custkey")
    stem = F.concat("c_name", F.when(k % 3 == 0, "_FU001d").otherwise(""))
    folder = F.concat(stem, F.when(k % 7 != 0, "_nifti").otherwise("_raw"))
    file = F.concat(F.lit("/data/site_1/"), stem, F.when(k % 2 == 0, "_flair.nii.gz").when(stem.contains("_"), ".NII").otherwise(".nii"))
    return t.table(spark, d, "customer").select("c_custkey", scalars.folder_stem(folder).alias("stem"), scalars.file_subject(file).alias("subject"))


@query("g4_path_parts", """SELECT page_id, nullif(split_part(url, '/', 3), '') AS host, CASE WHEN len(string_split(url, '/')) >= 4 THEN split_part(url, '/', 4) END AS first_part FROM pages""")
def path_parts(spark, d):
    return t.table(spark, d, "pages").select("page_id", scalars.path_part("url", 3).alias("host"), scalars.path_part("url", 4).alias("first_part"))


@query("g5_stable_pair_id", """SELECT o_orderkey, 'cmp:' || o_orderstatus || ':' || substr(sha256('cmp|' || o_orderstatus || '|' || o_custkey || '|' || o_orderkey), 1, 12) AS pair_id FROM orders""")
def stable_pair_id(spark, d):
    pair = scalars.stable_pair_id("cmp", F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderkey"))
    return t.table(spark, d, "orders").select("o_orderkey", pair.alias("pair_id"))


JSON_SQL = """sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}')"""


@query("g6_row_fingerprint", f"SELECT l_orderkey, l_linenumber, l_returnflag, {JSON_SQL} AS fingerprint, count(*) AS n FROM lineitem GROUP BY ALL")
def row_fingerprint(spark, d):
    cols = ["l_returnflag", "l_orderkey", "l_linenumber"]
    rows = t.table(spark, d, "lineitem").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("fingerprint", digests.fingerprint(cols))


@query("g7_set_digest", """SELECT l_suppkey, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}'), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM lineitem GROUP BY 1""")
def set_digest(spark, d):
    return digests.set_digest(t.table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("g7_ordered_digest", """WITH h AS (SELECT l_orderkey, l_linenumber, sha256('{"l_linenumber":' || l_linenumber || ',"l_quantity":' || CAST(q AS BIGINT) || '}') AS h FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(p || '|' || h), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS p FROM h) GROUP BY 1""")
def ordered_digest(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("l_quantity"))
    return digests.ordered_digest(rows, ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_quantity"])


@query("g9_json_safe", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"id":' || event_id || '}' ELSE '{"id":' || event_id || ',"v":' || CAST(round(value) AS BIGINT) || '}' END AS payload FROM events""")
def json_safe(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.round("value"))
    safe = scalars.json_safe(v).cast("long")
    return t.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), safe.alias("v"))).alias("payload"))


@query("g10_config_difference", """WITH p AS (SELECT event_type AS run, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS lo, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS hi, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT run, unnest([{'field': 'k', 'a': CAST(lo AS VARCHAR), 'b': CAST(hi AS VARCHAR)}, {'field': 'model.size', 'a': CAST(n AS VARCHAR), 'b': CAST(n AS VARCHAR)}, {'field': 'model.deep.parity', 'a': CAST(lo % 2 AS VARCHAR), 'b': CAST(n % 2 AS VARCHAR)},
 {'field': 'model.deep.list', 'a': '[' || lo || ',1]', 'b': '[' || hi || ',1]'}, {'field': 'model.name', 'a': '"{' || run || '"', 'b': '"{' || run || '"'}, {'field': 'only_a', 'a': 'true', 'b': NULL}, {'field': 'model.deep.b.c', 'a': NULL, 'b': CAST(n AS VARCHAR)}]) AS x FROM p)
SELECT run, x.field AS field, x.a AS a, x.b AS b FROM f WHERE x.a IS DISTINCT FROM x.b""")
def config_difference(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    per = t.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("{"), "run").alias("name")

    def document(edge, parity, extra, inner):
        deep = F.struct((F.col(parity) % 2).alias("parity"), F.array(F.col(edge), F.lit(1)).alias("list"), *inner)
        return per.select("run", F.to_json(F.struct(F.col(edge).alias("k"), F.struct(F.col("n").alias("size"), deep.alias("deep"), name).alias("model"), *extra)).alias("config"))

    a = document("lo", "lo", [F.lit(True).alias("only_a")], [])
    b = document("hi", "n", [], [F.struct(F.col("n").alias("c")).alias("b")])
    return configs.config_difference(a, b, ["run"], "config")


@query("g11_shape_text", "SELECT p_partkey, [p_size, p_size + 1, 155]::INTEGER[] AS shape FROM part")
def shape_text(spark, d):
    text = F.concat_ws(", ", "p_size", F.col("p_size") + 1, F.lit(155))
    return t.table(spark, d, "part").select("p_partkey", scalars.shape_array(text).alias("shape"))


@query("g12_nested_lookup", """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '-1') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def nested_lookup(spark, d):
    return t.table(spark, d, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-1")).cast("int").alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("g13_durations", """WITH e AS (SELECT user_id, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS s, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started FROM events GROUP BY 1)
SELECT user_id, s AS seconds, started, printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS elapsed FROM e""")
def durations(spark, d):
    span = t.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.unix_seconds(F.date_trunc("second", "b").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "a").cast("timestamp"))
    rows = span.select("user_id", seconds.alias("seconds"), F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss").alias("started"))
    return rows.withColumn("elapsed", scalars.duration_text("seconds"))


@query("g15_safe_divide", "SELECT l_suppkey, round(sum(l_tax) / greatest(sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END), 1), 9) AS ratio FROM lineitem GROUP BY 1")
def safe_divide(spark, d):
    return t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(scalars.ratio(F.sum("l_tax"), F.count_if(F.col("l_quantity") > 49)), 9).alias("ratio"))


@query("g16_piecewise_interpolation", """SELECT l_suppkey, round(avg(CASE WHEN l_quantity <= 10 THEN 0 + (l_quantity - 0) / 10 * 2 WHEN l_quantity <= 30 THEN 2 + (l_quantity - 10) / 20 * 5 ELSE 7 + (l_quantity - 30) / 20 * 3 END), 9) AS mapped FROM lineitem GROUP BY 1""")
def piecewise(spark, d):
    knots = [(0.0, 0.0), (10.0, 2.0), (30.0, 7.0), (50.0, 10.0)]
    x = F.col("l_quantity")
    value = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        value = F.when(x <= x1, scalars.interpolate(x, F.lit(x0), F.lit(x1), F.lit(y0), F.lit(y1))).otherwise(value)
    return t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(value), 9).alias("mapped"))


@query("e7_axis_differences", f"""WITH {S.PIXELS}, g AS (SELECT slice_id, channel, y, x, CAST(v AS DOUBLE) - CAST(lag(v) OVER (PARTITION BY slice_id, y ORDER BY x) AS DOUBLE) AS gx FROM pixels)
SELECT slice_id, round(avg(abs(gx)), 9) AS mean_gradient FROM g GROUP BY slice_id""")
def axis_differences(spark, d):
    # Differences along a row inside the array: no shuffle before the per-slice result.
    px = t.slices(spark, d).select("slice_id", F.transform("px", lambda v: v.cast("double")).alias("p"))
    steps = F.filter(F.transform("p", lambda v, i: F.when(i % 8 > 0, F.abs(v - F.get("p", i - 1)))), lambda g: g.isNotNull())
    total = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)
    return px.select("slice_id", F.round(total / F.size(steps), 9).alias("mean_gradient"))


@query("f3_preview", """WITH x AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, list_slice(list_sort(list(DISTINCT o_orderkey)), 1, 3) AS preview, count(*) AS failures FROM x GROUP BY 1""")
def preview(spark, d):
    # The preview length is the feature: rows beyond it are dropped before the shuffle, the count stays whole.
    from pyspark.sql import Window

    bad = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    first = bad.distinct().withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("k <= 3")
    lists = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("preview"))
    return lists.join(bad.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("failures")), "o_custkey")


@query("f7_numeric_order", r"""WITH x AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS n, p_brand FROM part) SELECT p_brand, n, row_number() OVER (ORDER BY n) - 1 AS position FROM x""")
def numeric_order(spark, d):
    from cohortlens.operators.scale import banded, ordinals

    names = t.table(spark, d, "part").select("p_brand").distinct().withColumn("n", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))
    repeated = names.groupBy("n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    from cohortlens.operators.sets import require_empty

    require_empty(repeated, "several checkpoints share a number")
    return ordinals(banded(names, "n"), [], ["n"], "position")


@query("f8_nearest_to_median", """WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem), r AS (SELECT l_suppkey, l_extendedprice, abs(l_extendedprice - med) AS gap FROM lineitem, m)
SELECT l_suppkey, round(min(gap), 6) AS gap FROM r GROUP BY 1""")
def nearest_to_median(spark, d):
    from cohortlens.operators.scale import exact_quantiles

    lines = t.table(spark, d, "lineitem")
    med = exact_quantiles(lines, [], "l_extendedprice", {"med": 0.5})
    near = attach_scalar(lines.select("l_suppkey", "l_extendedprice"), med)
    return near.groupBy("l_suppkey").agg(F.round(F.min(F.abs(F.col("l_extendedprice") - F.col("med"))), 6).alias("gap"))
