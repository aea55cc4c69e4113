"""Sources and sinks: the given tables are written in each format and read back through the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import adaptive, audits, confusion, sets, sweep
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t
from cohortlens.sources import manifests, metrics_csv, writers


def as_csv(df, sep=","):
    path = writers.scratch(df.sparkSession, "csv")
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("s1_subject_csv", "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_mktsegment AS site FROM customer")
def subject_csv(spark, d):
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("site"))
    return manifests.read_subject_csv(spark, as_csv(rows))


@query("s2_csv_with_bom", "SELECT c_mktsegment AS site, count(*) AS n FROM customer GROUP BY 1")
def csv_with_bom(spark, d):
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias(manifests.BOM + "subject_id"), F.col("c_mktsegment").alias("site"))
    read = manifests.read_csv(spark, as_csv(rows), required=("subject_id", "site"))
    return read.groupBy("site").agg(F.count("subject_id").alias("n"))


@query("s3_jsonl_manifest", f"WITH {S.RECORDS} SELECT 'set:' || case_id || ':' || z AS record_id, participant || '' AS participant_id, z, z_bin, label, round(z_norm, 9) AS z_norm, 'final' AS stage, 'seg-' || z AS seg_path, z + 8 AS depth, '{{\"step\":' || z || '}}' AS provenance, 'own' AS site, '' || label AS operator_note FROM records")
def jsonl_manifest(spark, d):
    rows = t.records(spark, d).select(
        F.col("domain"), F.col("participant").cast("string").alias("participant_id"), F.col("case_id").cast("string").alias("case_id"),
        F.lit("set").alias("source_dataset"), "label", "z", "z_norm", "z_bin", F.create_map(F.lit("FLAIR"), F.col("record_id")).alias("image_paths"),
        F.concat(F.lit("seg-"), "z").alias("seg_path"), F.array(F.col("z") + 8, F.lit(8)).alias("geometry_shape"), F.struct(F.col("z").alias("step")).alias("provenance"),
        F.create_map(F.lit("site"), F.lit("own")).alias("metadata"), F.lit("lost to the record's own entry").alias("site"), F.col("label").cast("string").alias("operator_note"))
    path = writers.scratch(spark, "jsonl")
    rows.write.json(path)
    read = manifests.read_jsonl_manifest(spark, path)
    return read.select(manifests.record_id(read).alias("record_id"), "participant_id", "z", "z_bin", "label", F.round("z_norm", 9).alias("z_norm"),
                       "stage", "seg_path", F.get("geometry_shape", F.lit(0)).alias("depth"), "provenance", F.col("metadata")["site"].alias("site"), F.col("metadata")["operator_note"].alias("operator_note"))


@query("s4_metadata_tsv", "SELECT CAST(o_custkey AS VARCHAR) AS participant, count(*) AS sessions FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def metadata_tsv(spark, d):
    orders = t.table(spark, d, "orders")
    rows = orders.select(F.lit("set").alias("dataset"), F.col("o_orderstatus").alias("group"), F.col("o_custkey").alias("participant"), F.col("o_orderkey").alias("session"))
    mine = orders.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("o_custkey").alias("participants")).first().asDict()
    read = manifests.read_metadata_tsv(spark, as_csv(rows, "\t"), ("dataset", "group", "participant", "session"), "set", "F", mine)
    return read.groupBy("participant").agg(F.count(F.lit(1)).alias("sessions"))


@query("s5_session_discovery", """WITH f AS (SELECT o_custkey AS p, year(o_orderdate) AS s, o_orderpriority AS q, o_orderkey AS k FROM orders), c AS (SELECT CAST(p AS VARCHAR) AS participant, CAST(s AS VARCHAR) AS session, count(*) FILTER (WHERE q = '1-URGENT') AS nf, count(*) FILTER (WHERE q IN ('2-HIGH', '3-MEDIUM')) AS n1, count(*) FILTER (WHERE q = '4-NOT SPECIFIED') AS n2 FROM f GROUP BY ALL)
SELECT participant, session, CASE WHEN n1 <> 1 OR nf > 1 OR n2 > 1 THEN 'EXCLUDED' WHEN nf = 0 OR n2 = 0 THEN 'PARTIAL' ELSE 'READY' END AS status,
 list_filter([CASE WHEN nf > 1 THEN 'ambiguous_flair:' || nf WHEN nf = 0 THEN 'missing_flair' END, CASE WHEN n1 > 1 THEN 'ambiguous_t1:' || n1 WHEN n1 = 0 THEN 'missing_t1' END, CASE WHEN n2 > 1 THEN 'ambiguous_t2:' || n2 WHEN n2 = 0 THEN 'missing_t2' END], lambda x: x IS NOT NULL) AS reasons FROM c""")
def session_discovery(spark, d):
    token = F.create_map(*[F.lit(v) for v in ("1-URGENT", "flair", "2-HIGH", "t1", "3-MEDIUM", "t1w", "4-NOT SPECIFIED", "t2", "5-LOW", "t1ce")])
    name = F.concat(F.lit("img-"), F.col("o_orderkey"), F.lit("_"), F.element_at(token, F.col("o_orderpriority")), F.lit(".nii.gz"))
    listing = t.table(spark, d, "orders").select(F.concat_ws("/", F.lit("root"), "o_custkey", F.year("o_orderdate"), name).alias("path"))
    return manifests.discover_sessions(listing).select("participant", "session", "status", "reasons")


@query("s6_slice_store", "SELECT vec_id AS slice_id, label AS channel, len(embedding) AS size FROM embeddings")
def slice_store(spark, d):
    path = writers.scratch(spark, "store")
    t.slices(spark, d).write.parquet(path)
    store = manifests.read_slice_store(spark, path, expected=t.slices(spark, d).count())
    return store.select("slice_id", "channel", F.size("px").cast("long").alias("size"))


@query("s7_slice_write", "SELECT CASE WHEN label < 7 THEN 'train' ELSE 'test' END AS split, vec_id AS slice_id, row_number() OVER (PARTITION BY label < 7 ORDER BY vec_id) - 1 AS slice_key FROM embeddings")
def slice_write(spark, d):
    rows = t.slices(spark, d).withColumn("split", F.when(F.col("channel") < 7, "train").otherwise("test"))
    return spark.read.parquet(manifests.write_slice_store(rows, "slice_id")).select("split", "slice_id", "slice_key")


@query("s8_manifest_products", f"WITH {S.SPLITS} SELECT split, count(*) AS rows FROM records JOIN split_map USING (participant) GROUP BY split")
def manifest_products(spark, d):
    mapped = t.split_records(spark, d)
    return manifests.write_manifest_products(mapped)[1]


THRESHOLDS = sweep.threshold_list(0.0, 0.1, 0.02)


def metric_table(spark, d):
    """Long metrics of the discount scores: a threshold sweep and named rows."""
    df = t.elements(spark, d, "l_discount")
    rows = sweep.sweep_metrics(df, THRESHOLDS)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(c, 9).alias("v")) for m, c in (("value", "dice"), ("dice", "dice"), ("sensitivity", "sensitivity"), ("precision", "precision"))])
    long = rows.select(F.lit(None).cast("string").alias("key"), "thr", F.explode(cells).alias("_c")).select("key", "thr", "_c.metric", "_c.v")
    own = adaptive.adaptive_summary(adaptive.adaptive_counts(df, adaptive.adaptive_thresholds(df, "otsu")))
    named = own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.round(c, 7).alias("v")) for k, c in (("otsu", "dice"), ("otsuthr", "threshold"), ("otsusen", "sensitivity"), ("otsupre", "precision"))])).alias("_c"))
    return long.unionByName(named.select("_c.key", F.lit(None).cast("double").alias("thr"), F.lit("value").alias("metric"), "_c.v"))


SWEEP5 = f"""{S.TIED}, thr(thr) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}), x AS (SELECT thr, subject, label, score > CAST(thr AS FLOAT) AS p FROM tied, thr),
c AS (SELECT thr, subject, count(*) FILTER (WHERE p AND label) AS tp, count(*) FILTER (WHERE p AND NOT label) AS fp, count(*) FILTER (WHERE NOT p AND label) AS fn FROM x GROUP BY ALL),
sw AS (SELECT thr, round(avg(2.0 * tp / greatest(2 * tp + fp + fn, 1e-8)), 9) AS dice, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 9) AS sensitivity, round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 9) AS precision FROM c GROUP BY thr)"""


@query("s9_metric_csv", f"WITH {SWEEP5} SELECT thr, dice AS value, dice, sensitivity, precision FROM sw")
def metric_csv(spark, d):
    long = metric_table(spark, d).where("key IS NULL")
    path = writers.write_csv(writers.metric_rows(long), writers.scratch(spark, "metrics"))
    read = manifests.read_csv(spark, path, ("thr", "value", "dice", "sensitivity", "precision"))
    return read.select(*[F.col(c).cast("double").alias(c) for c in ("thr", "value", "dice", "sensitivity", "precision")])


# Metric files as four writers leave them: a sweep with named rows, names and values, one wide table, a sweep from the top.
WRITERS = {"run1": "five", "run2": "five", "run3": "pair", "run4": "pair", "run5": "wide", "run6": "wide", "run7": "own"}
RUN_METRICS = {"ap": "avg(l_discount) * 3", "m": "avg(l_tax) * 5", "mt": "max(l_discount) * 2", "ms": "avg(l_quantity) / 100", "mp": "avg(l_quantity) / 90"}
SWEEP_METRICS = {"dice": "round(avg(l_discount), 3)", "s": "round(avg(l_tax), 9)", "p": "round(avg(l_extendedprice) / 100000, 9)"}


def metric_files(spark, d):
    """One metric file per line number, written by its own rules; returns the folder."""
    items = t.table(spark, d, "lineitem").withColumn("run", F.concat(F.lit("run"), "l_linenumber"))
    metrics = items.groupBy("run").agg(*[F.round(F.expr(e), 9).cast("string").alias(n) for n, e in RUN_METRICS.items()])
    cells = F.concat_ws(",", *[F.col(c).cast("string") for c in ("s", "p")])
    at = items.groupBy("run", (F.col("l_quantity") / 100).alias("thr")).agg(*[F.expr(e).alias(n) for n, e in SWEEP_METRICS.items()])
    # At most 50 thresholds a run.
    sweeps = at.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("thr", F.col("dice").cast("string").alias("dice"), cells.alias("cells")))).alias("sweep"))

    def lines(*parts):
        return [F.array(*[F.concat(*[F.col(x) if x in RUN_METRICS else F.lit(x) for x in line]) for line in parts])]

    five = [F.array(F.lit("\ufeffthr,value,dice,sensitivity,precision")), F.transform("sweep", lambda x: F.concat(x.thr.cast("string"), F.lit(",,"), x.dice, F.lit(","), x.cells)),
            *lines(["AUPRC,", "ap", ",,,"], ["ap,0.5,,,"], ["Otsu,", "m", ",,,"], ["otsu threshold,", "mt", ",,,"], ["otsuSen,", "ms", ",,,"], ["otsu_pre,", "mp", ",,,"])]
    pair = lines(["Metric,Value"], ["Average Precision,", "ap"], ["best dice,", "m"], [""], ["best threshold,", "mt"], ['"Yun",', "m"], ["Yun Threshold,", "mt"], ["Yen Sensitivity,", "ms"], ["yunpre,", "mp"], ["Yen,none"])
    wide = lines(["case,AP,Max Dice,Dice Otsu,Sen,note"], ["all,,", "m", ",", "mp", ",", "ms", ',"a, ""b""\n"'], ["rest,", "ap", ",0.9,0.9,,x"])
    own = [F.array(F.lit("threshold,score,sen,pre")), F.transform(F.reverse("sweep"), lambda x: F.concat(x.thr.cast("string"), F.lit(","), x.dice, F.lit(","), x.cells)),
           *lines(["learned_threshold,", "m", ",,"], ["learned_threshold thr,", "mt", ",,"], ["learned_thresholdsen,", "ms", ",,"])]
    body = F.lit(None).cast("array<string>")
    for kind, parts in {"five": five, "pair": pair, "wide": wide, "own": own}.items():
        body = F.when(F.col("run").isin(*[r for r, k in WRITERS.items() if k == kind]), F.concat(*parts)).otherwise(body)
    root = writers.scratch(spark, "metric-files")
    metrics.join(sweeps, "run").select("run", F.concat_ws("\n", body).alias("value")).write.partitionBy("run").text(root)
    return root


def _summary_sql() -> str:
    x = {c: {} for c in metrics_csv.COLUMNS}
    best = {"bestdice": "d", "bestthr": "t", "bestsen": "s", "bestpre": "p"}
    named = {"dice": "m", "thr": "mt", "sen": "ms", "pre": "mp"}
    x["AUPRC"] = {"five": "ap", "pair": "ap", "wide": "ap"}
    for c, v in best.items():
        x[c] = {"five": f"b.{v}", "own": f"o.{v}"}
    x["bestdice"] |= {"pair": "m", "wide": "m"}
    x["bestthr"] |= {"pair": "mt"}
    x["bestsen"] |= {"wide": "ms"}
    for part, v in named.items():
        x[f"otsu{part}"], x[f"yen{part}"] = {"five": v}, {"pair": v}
    x["otsudice"]["wide"] = "mp"
    for c, part in (("adaptive_dice", "dice"), ("adaptive_threshold", "thr"), ("adaptive_sensitivity", "sen"), ("adaptive_precision", "pre")):
        x[c] = {"five": named[part], "pair": named[part], "own": named[part] if part != "pre" else "NULL"}
    x["adaptive_dice"]["wide"] = "mp"
    x["adaptive_method"] = {"five": "'otsu'", "pair": "'yen'", "wide": "'otsu'", "own": "'learned_threshold'"}
    columns = ", ".join(f"CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in of.items())} END AS \"{c}\"" for c, of in x.items())
    kinds = ", ".join(f"('{r}', '{k}')" for r, k in WRITERS.items())
    return f"""kinds(run, kind) AS (VALUES {kinds}),
mt AS (SELECT 'run' || l_linenumber AS run, {', '.join(f'round({e}, 9) AS {n}' for n, e in RUN_METRICS.items())} FROM lineitem GROUP BY 1),
sw AS (SELECT 'run' || l_linenumber AS run, l_quantity / 100 AS thr, {', '.join(f'{e} AS {n}' for n, e in SWEEP_METRICS.items())} FROM lineitem GROUP BY 1, 2),
low AS (SELECT run, max(dice) AS d, arg_max(thr, (dice, -thr)) AS t, arg_max(s, (dice, -thr)) AS s, arg_max(p, (dice, -thr)) AS p FROM sw GROUP BY run),
top AS (SELECT run, max(dice) AS d, arg_max(thr, (dice, thr)) AS t, arg_max(s, (dice, thr)) AS s, arg_max(p, (dice, thr)) AS p FROM sw GROUP BY run),
summary AS (SELECT run, {columns} FROM kinds JOIN mt USING (run) JOIN low b USING (run) JOIN top o USING (run))"""


@query("s10_metric_reader", f"WITH {_summary_sql()} SELECT * FROM summary")
def metric_reader(spark, d):
    return metrics_csv.summarize(metrics_csv.read_metric_files(spark, metric_files(spark, d)), ["run"])


# Tables of a study by version: (study, branch, run). One version was never written, one is missing.
VERSIONS = [("a", "raw", "run1"), ("a", "median_filter", "run7"), ("b", "raw", "run3"), ("b", "median_filter", "run6"), ("c", "raw", "run2"), ("c", "median_filter", None), ("d", "raw", "run4"), ("d", "median_filter", "run9")]


@query("s11_two_version_summary", f"""WITH {_summary_sql()}, v(study, branch, run) AS (VALUES {', '.join(f"('{s}', '{b}', {'NULL' if r is None else repr(r)})" for s, b, r in VERSIONS)})
SELECT v.study, v.branch, v.run, summary.* EXCLUDE (run), CASE WHEN v.run IS NULL THEN 'metrics table not available' WHEN summary.run IS NULL THEN 'metrics table not found: ' || v.run END AS warning FROM v LEFT JOIN summary USING (run)""")
def two_versions(spark, d):
    summary = metrics_csv.summarize(metrics_csv.read_metric_files(spark, metric_files(spark, d)), ["run"])
    return metrics_csv.two_versions(spark.createDataFrame(VERSIONS, "study string, branch string, run string"), summary, "run")


@query("s12_staged_publication", "SELECT label AS channel, count(*) AS n FROM embeddings GROUP BY 1")
def staged_publication(spark, d):
    rows = t.slices(spark, d)
    total = rows.count()

    def audit(written):
        if written.count() != total:
            raise sets.AuditError("published rows differ from the source")

    path = writers.publish(rows, writers.scratch(spark, "published"), audit)
    try:
        writers.publish(rows, path, audit)
        raise AssertionError("a non-empty target was replaced")
    except FileExistsError:
        pass
    return spark.read.parquet(path).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("s13_merged_stores", """WITH u AS (SELECT 'low' AS source, vec_id AS source_key FROM embeddings WHERE label < 4 UNION ALL SELECT 'high', vec_id FROM embeddings WHERE label >= 3)
SELECT source, source_key, row_number() OVER (ORDER BY md5('73|' || source || ':' || source_key), source || ':' || source_key) - 1 AS slice_key FROM u""")
def merged_stores(spark, d):
    rows = t.slices(spark, d)
    out = manifests.merge_stores({"low": rows.where("channel < 4"), "high": rows.where("channel >= 3")}, "slice_id", {"low": "iqr-v1", "high": "iqr-v1"}, 73)
    return out.select("source", "source_key", "slice_key")


@query("s14_artifact_scan", "SELECT o_orderpriority AS run, count(*) AS predictions FROM orders GROUP BY 1")
def artifact_scan(spark, d):
    orders = t.table(spark, d, "orders").select("o_orderkey", F.translate("o_orderpriority", " ", "_").alias("priority"), "o_orderpriority")
    root = writers.scratch(spark, "runs")
    orders.write.partitionBy("priority").json(f"{root}/results")
    orders.write.json(f"{root}/cache")
    found = manifests.scan_artifacts(spark, [root], "*.json")
    # Only paths of result files are kept; each is then read as rows of its run.
    paths = found.select(F.regexp_extract("path", "(.*)/[^/]+$", 1).alias("dir")).distinct()
    runs = paths.select(F.regexp_replace(F.regexp_extract("dir", "priority=(.*)$", 1), "_", " ").alias("run")).where("run <> ''")
    rows = spark.read.json(f"{root}/results").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("predictions"))
    return rows.join(runs, "run", "left_semi")


@query("s15_payload_explode", f"WITH {S.predictions(split=None)} SELECT pair_id, split, CAST(participant AS VARCHAR) AS participant, label, probability FROM predictions")
def payload_explode(spark, d):
    rows = t.predictions(spark, d, split=None)
    entry = F.struct(F.col("participant").cast("string").alias("participant"), "label", "probability")
    # One payload per pair, so a payload is small.
    payloads = rows.groupBy("pair_id").agg(*[F.collect_list(F.when(F.col("split") == s, entry)).alias(f"{n}_predictions") for s, n in (("train", "train"), ("val", "validation"), ("test", "test"))])
    texts = payloads.select("pair_id", F.to_json(F.struct("train_predictions", "validation_predictions", "test_predictions")).alias("payload"))
    return manifests.explode_payload(texts, "payload", ["pair_id"])


@query("x4_adapter_registry", "SELECT l_suppkey AS subject, count(*) AS n, count(*) FILTER (WHERE l_tax > 0) AS positive FROM lineitem GROUP BY 1")
def adapter_registry(spark, d):
    path = writers.scratch(spark, "masked")
    t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("z"), F.col("l_discount").alias("score"), F.col("l_tax").alias("mask")).write.parquet(path)
    return manifests.adapters["masked"](spark, path).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positive"))


@query("x6_sql_callable", f"""WITH {S.predictions(split=None)}, tie AS (SELECT split, probability AS score, count(*) AS n, sum(label) AS pos FROM predictions GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY split ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY split) AS tn, sum(pos) OVER (PARTITION BY split) AS tp FROM tie)
SELECT split, CAST(max(tn) AS BIGINT) AS n, round(sum(pos * (cp / cn)) / max(tp), 9) AS ap, round(sum(pos * (2 * ((tn - tp) - (cn - cp)) + (n - pos)))::DOUBLE / (2.0::DOUBLE * max(tp) * (max(tn) - max(tp))), 9) AS auc FROM w GROUP BY split""")
def sql_callable(spark, d):
    from cohortlens.plans.sql_templates import ranking_sql

    t.predictions(spark, d, split=None).createOrReplaceTempView("slice_predictions")
    out = spark.sql(ranking_sql("slice_predictions", ["split"], "probability", "label"))
    return out.select("split", "n", F.round("ap", 9).alias("ap"), F.round("auc", 9).alias("auc"))


HOLM_ROWS = "SELECT c_mktsegment AS family, c_custkey AS test, CASE WHEN c_custkey % 50 <> 0 THEN power((c_custkey * 37 % 500) / 500.0::DOUBLE, 4) END AS p FROM customer"


@query("x6_holm_callable", f"""WITH h AS ({HOLM_ROWS}), s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS v FROM h WHERE p IS NOT NULL),
a AS (SELECT family, test, max(v) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS p_holm FROM s) SELECT family, test, round(p_holm, 12) AS p_holm FROM h LEFT JOIN a USING (family, test)""")
def holm_callable(spark, d):
    from cohortlens.plans.sql_templates import holm_sql

    p = F.pow((F.col("c_custkey") * 37 % 500) / F.lit(500.0), F.lit(4.0))
    t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("test"), F.when(F.col("c_custkey") % 50 != 0, p).alias("p")).createOrReplaceTempView("planned_tests")
    return spark.sql(holm_sql("planned_tests", ["family"], "p")).select("family", "test", F.round("p_holm", 12).alias("p_holm"))
