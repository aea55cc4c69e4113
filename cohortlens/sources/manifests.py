"""Readers of manifests, listings and slice stores, with the checks each source needs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import scalars
from cohortlens.functions.registry import Registry
from cohortlens.operators import sets
from cohortlens.operators.scale import attach
from cohortlens.sources import writers

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """CSV or TSV with header, all columns as text; a byte order mark on the first header is removed."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    first = df.columns[0]
    cleaned = first.lstrip(BOM).strip('"')
    if cleaned != first:
        df = df.withColumnRenamed(first, cleaned)
    return sets.require_columns(df, required)


def read_subject_csv(spark: SparkSession, path: str, label: str = "subject list") -> DataFrame:
    """Subject list whose first column is the id; empty lists and repeated ids are errors."""
    df = read_csv(spark, path)
    key = df.columns[0]
    if df.isEmpty():
        raise sets.AuditError(f"{label} contains no subjects: {path}")
    sets.require_empty(sets.duplicates(df, [key]), f"{label} repeats subject ids")
    return df


# The fields of a record.
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "split", "domain", "participant_id", "session_id", "case_id", "source_dataset", "source_key", "source_split", "seg_path", "model_mask_path", "pair_id", "stage", "provenance")]
    + [T.StructField(n, T.IntegerType()) for n in ("label", "z", "z_bin")]
    + [T.StructField("z_norm", T.DoubleType())]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("image_paths", "registered_paths", "metadata")]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("geometry_shape", "model_shape")]
    + [T.StructField("foreground_fraction", T.ArrayType(T.DoubleType()))]
    + [T.StructField(n, T.LongType()) for n in ("native_seg_voxels", "model_mask_voxels")]
)


def read_jsonl_manifest(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """One JSON object per line; a line that does not parse stops the job.

    Fields that the schema does not name are kept as text in ``metadata``, where the record's own entries come first.
    A missing stage is "final"; nested provenance stays JSON text.
    """
    bad = "_corrupt_record"
    with_bad = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select(
        F.from_json("value", with_bad, {"columnNameOfCorruptRecord": bad}).alias("r"),
        F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"),
    )
    first = schema.fields[0].name
    columns = {f.name: F.col(f"r.{f.name}") for f in schema.fields}
    columns[first] = scalars.fail_unless(F.col(f"r.{bad}").isNull(), columns[first], "manifest line is not valid JSON")
    if "metadata" in columns:
        none = F.create_map().cast("map<string,string>")
        own = F.coalesce("r.metadata", none)
        extra = F.map_filter(F.coalesce("m", none), lambda k, v: ~k.isin(*columns) & ~F.map_contains_key(own, k))
        columns["metadata"] = F.map_concat(own, extra)
    if "stage" in columns:
        columns["stage"] = F.coalesce(columns["stage"], F.lit("final"))
    return read.select(*[c.alias(n) for n, c in columns.items()])


def record_id(df: DataFrame) -> Column:
    full = F.concat_ws(":", "source_dataset", "source_split", "source_key")
    return F.when(F.col("source_key").isNotNull() & (F.col("source_key") != ""), full).otherwise(F.concat_ws(":", "source_dataset", "case_id", "z"))


def read_metadata_tsv(spark: SparkSession, path: str, required: Sequence[str], dataset: str, group: str, expected: Mapping[str, int]) -> DataFrame:
    """Metadata rows of one dataset and group: unique (participant, session), exactly the expected counts."""
    rows = read_csv(spark, path, required, sep="\t").where((F.col("dataset") == dataset) & (F.col("group") == group))
    sets.require_empty(sets.duplicates(rows, ["participant", "session"]), "metadata repeats a session")
    found = rows.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("participant").alias("participants")).first()
    wrong = {k: (found[k], v) for k, v in expected.items() if found[k] != v}
    if wrong:
        raise sets.AuditError(f"metadata counts differ from the configuration (found, expected): {wrong}")
    return rows


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files under a root; the contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")


MODALITIES = ("flair", "t1", "t2")


def discover_sessions(listing: DataFrame, path: str = "path") -> DataFrame:
    """Group a listing ``participant/session/file`` to sessions: one path per modality, status and reasons.

    A session without T1 or with an ambiguous modality is EXCLUDED, one without another modality PARTIAL, else READY.
    """
    name = F.substring_index(F.col(path), "/", -1)
    files = listing.select(
        scalars.path_part(path, -3).alias("participant"), scalars.path_part(path, -2).alias("session"), F.col(path).alias("_p"),
        scalars.modality_from_name(name).alias("_m"),
    )
    aggs = []
    for m in MODALITIES:
        aggs += [F.countDistinct(F.when(F.col("_m") == m, F.col("_p"))).alias(f"_n_{m}"), F.min(F.when(F.col("_m") == m, F.col("_p"))).alias(f"_p_{m}")]
    per = files.groupBy("participant", "session").agg(*aggs)
    reasons = F.array_compact(F.array(*[
        F.when(F.col(f"_n_{m}") > 1, F.concat(F.lit(f"ambiguous_{m}:"), F.col(f"_n_{m}"))).when(F.col(f"_n_{m}") == 0, F.lit(f"missing_{m}"))
        for m in ("flair", "t1", "t2")
    ]))
    ambiguous = F.exists(reasons, lambda r: r.startswith("ambiguous_"))
    status = (
        F.when((F.col("_n_t1") != 1) | ambiguous, "EXCLUDED").when((F.col("_n_t2") == 0) | (F.col("_n_flair") == 0), "PARTIAL").otherwise("READY")
    )
    paths = [F.when(F.col(f"_n_{m}") == 1, F.col(f"_p_{m}")).alias(f"{m}_path") for m in MODALITIES]
    return per.select("participant", "session", *paths, status.alias("status"), reasons.alias("reasons"))


def read_slice_store(spark: SparkSession, path: str, key: str = "slice_id", expected: int | None = None) -> DataFrame:
    """Slice table with contiguous keys 0 … n−1 and, when given, exactly ``expected`` entries."""
    df = spark.read.parquet(path)
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("entries"), F.count(F.lit(1)).alias("keys"), F.min(key).alias("low"), F.max(key).alias("high")
    ).first()
    whole = found["keys"] == found["entries"] and found["low"] == 0 and found["high"] == found["keys"] - 1
    if not whole or (expected is not None and found["entries"] != expected):
        raise sets.AuditError(f"slice store is not contiguous or has the wrong size: {found.asDict()}")
    return df


def write_slice_store(df: DataFrame, order: str, path: str | None = None, split: str = "split") -> str:
    """Write slices partitioned by split with contiguous keys per split in ``order``."""
    from cohortlens.operators.scale import banded, ordinals

    keyed = ordinals(banded(df, order), [split], [order], "slice_key")
    return writers.write_partitioned(keyed, split, path=path)


def write_manifest_products(df: DataFrame, path: str | None = None, split: str = "split") -> tuple[str, DataFrame]:
    """All rows partitioned by split, and the counts that belong into the accompanying report."""
    target = writers.write_partitioned(df, split, path=path)
    counts = df.sparkSession.read.parquet(target).groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    return target, counts


def merge_stores(stores: Mapping[str, DataFrame], key: str, specs: Mapping[str, str], seed: int) -> DataFrame:
    """Mixed store in seeded order with a source ledger; all stores must carry the same normalization spec."""
    from cohortlens.functions import draws

    if len(set(specs.values())) != 1:
        raise sets.AuditError(f"stores were normalized differently: {dict(specs)}")
    rows = sets.union([df.withColumn("source", F.lit(name)) for name, df in stores.items()])
    tagged = rows.withColumnRenamed(key, "source_key").withColumn("_uid", F.concat_ws(":", "source", "source_key"))
    return draws.permuted(tagged, "_uid", seed, out="slice_key").drop("_uid")


# Directory names that never hold results.
EXCLUDED_DIRECTORIES = ("cache", "images", "checkpoints", "figures")


def scan_artifacts(spark: SparkSession, roots: Sequence[str], glob: str = "*.json") -> DataFrame:
    """(path, run) of result files under run roots, without cache, image and checkpoint directories."""
    found = []
    for root in roots:
        run = root.rstrip("/").rsplit("/", 1)[-1]
        # Only directories below the run root decide.
        inside = F.substring_index("path", run, -1)
        files = list_files(spark, root, glob).where(~inside.rlike("/(" + "|".join(EXCLUDED_DIRECTORIES) + ")/"))
        found.append(files.select("path", F.lit(run).alias("run")))
    return sets.union(found)


PREDICTION = "array<struct<participant:string,label:int,probability:double>>"


def explode_payload(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction rows of a nested result object, tagged with their split."""
    schema = f"train_predictions {PREDICTION}, validation_predictions {PREDICTION}, test_predictions {PREDICTION}"
    parsed = df.select(*keep, F.from_json(payload, schema).alias("_j"))
    parts = F.array(*[
        F.struct(F.lit(s).alias("split"), F.coalesce(F.col(f"_j.{name}_predictions"), F.array().cast(PREDICTION)).alias("rows"))
        for s, name in (("train", "train"), ("val", "validation"), ("test", "test"))
    ])
    splits = parsed.select(*keep, F.explode(parts).alias("_s"))
    rows = splits.select(*keep, F.col("_s.split").alias("split"), F.explode("_s.rows").alias("_r"))
    return rows.select(*keep, "split", "_r.*")


# name → reader(spark, path) returning (subject, z, y, x, score, label)
adapters: Registry[Callable[[SparkSession, str], DataFrame]] = Registry("dataset adapter")


@adapters.register("elements", "parquet")
def read_elements(spark: SparkSession, path: str) -> DataFrame:
    df = sets.require_columns(spark.read.parquet(path), ("subject", "z", "score"))
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("boolean")
    return df.select("subject", "z", F.col("score").cast("float").alias("score"), label.alias("label"))


@adapters.register("masked")
def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """Elements with a categorical mask, where any positive category counts as a label."""
    df = sets.require_columns(spark.read.parquet(path), ("subject", "z", "score", "mask"))
    return df.select("subject", "z", F.col("score").cast("float").alias("score"), scalars.mask_label("mask").alias("label"))
