"""Views of the input tables in the shape of the study: scored elements, manifest records, predictions, slices.

Each view is a lazy projection or join of the given parquet tables; Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import draws, scalars
from cohortlens.operators.scale import staged

DEPTH = 7
BINS = 20
SEED = 73


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str, score: str = "l_extendedprice") -> DataFrame:
    """Scored elements: (subject, z, modality, score FLOAT, label BOOLEAN)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        F.col("l_linenumber").alias("z"),
        F.col("l_linestatus").alias("modality"),
        F.col(score).cast("float").alias("score"),
        (F.col("l_returnflag") == "R").alias("label"),
    )


def records(spark: SparkSession, sf_dir: str, bins: int = BINS) -> DataFrame:
    """Manifest rows, one per (participant, case, z), with the label from the parity of the customer's region."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    slices = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("quantity"), F.min("l_suppkey").alias("source_key")
    )
    joined = (
        slices.join(orders, slices.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
    )
    z = (F.col("l_linenumber") - 1).cast("int")
    label = (F.col("n_regionkey") % 2).cast("int")
    return joined.select(
        F.col("c_custkey").alias("participant"),
        F.col("l_orderkey").alias("case_id"),
        z.alias("z"),
        scalars.z_norm(z, F.lit(DEPTH)).alias("z_norm"),
        scalars.z_bin(scalars.z_norm(z, F.lit(DEPTH)), bins).alias("z_bin"),
        label.alias("label"),
        F.when(label == 0, "healthy").otherwise("lesion").alias("domain"),
        F.col("n_regionkey").alias("source"),
        F.col("c_mktsegment").alias("site"),
        F.col("o_orderpriority").alias("stage"),
        (F.col("quantity") / 50).alias("support"),
        F.col("source_key"),
        F.concat_ws(":", F.lit("set"), F.col("l_orderkey"), z).alias("record_id"),
    )


def probability(seed, key, label, weight: float = 0.25):
    """A deterministic stand-in for a classifier's output: a hashed uniform number shifted by the label."""
    return F.round(F.lit(weight) * label + F.lit(1 - weight) * draws.hash_unit(seed, key), 4)


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct participants of ``records``: who has an order with a line. No slice has to be formed for this."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi").select("o_custkey").distinct()
    return owners.join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_custkey").alias("participant"))


def split_records(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The manifest, written once, with the split of each participant; only ``columns`` where a query needs few."""
    from cohortlens.operators import splits

    rows = records(spark, sf_dir)
    if columns is not None:
        rows = rows.select(*columns)
    people = staged(participants(spark, sf_dir))
    return staged(splits.apply_split_map(rows, splits.participant_split(people, "participant")))


def paired_records(spark: SparkSession, sf_dir: str, mapped: DataFrame | None = None) -> DataFrame:
    """Matched pairs of the split records, one row per selected slice. ``mapped`` is the manifest where a query has it already."""
    from cohortlens.operators import pairing

    # The manifest is read by every step of the pairing: written once, then scanned with pruned columns. So is the pair
    # manifest, an artifact of the study that every later step reads.
    if mapped is None:
        mapped = split_records(spark, sf_dir)
    return staged(pairing.build_pairs(mapped.where("label = 0"), mapped.where("label = 1"), seed=SEED).records)


def predictions(spark: SparkSession, sf_dir: str, seeds=(1,), split: str | None = "test") -> DataFrame:
    """Slice predictions of matched pairs: (seed, split, pair_id, participant, case_id, z, label, probability)."""
    rows = paired_records(spark, sf_dir)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return rows.select(
        "seed", "split", "pair_id", "participant", "case_id", "z", "z_bin", "label", "source", "record_id",
        probability(F.col("seed"), "record_id", F.col("label")).alias("probability"),
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8×8 slices: (slice_id, channel, px ARRAY<FLOAT>)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("slice_id"), F.col("label").alias("channel"), F.col("embedding").alias("px")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of ``slices``: (slice_id, channel, y, x, v FLOAT)."""
    exploded = slices(spark, sf_dir).select("slice_id", "channel", F.posexplode("px").alias("pos", "v"))
    return exploded.select(
        "slice_id", "channel", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "v"
    )


def intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground values by modality: (case_id, modality, v DOUBLE, reference_group)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("case_id"),
        F.col("l_linestatus").alias("modality"),
        F.col("l_returnflag").alias("cohort"),
        F.col("l_extendedprice").alias("v"),
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("d"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("stage"), F.col("value").alias("seconds")
    )
