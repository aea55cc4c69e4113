"""Matched pairs, control cohorts and label permutations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import draws, scalars
from cohortlens.operators.scale import attach, staged

# Offset of the pairing stream of each split, and of the second side.
SPLIT_OFFSETS = {"train": 0, "val": 1009, "test": 2018}
SIDE_OFFSET = 17


@dataclass(frozen=True)
class Pairing:
    """``records`` with their pair, one summary row per pair, and the participant pairs without a common bin."""

    records: DataFrame
    pairs: DataFrame
    exclusions: DataFrame


def split_offset(split: Column) -> Column:
    return scalars.lookup(SPLIT_OFFSETS, split)


def primary_case(rows: DataFrame, participant: str = "participant", case: Sequence[str] = ("case_id",), within: Sequence[str] = ()) -> DataFrame:
    """Rows of each participant's first case, per value of ``within``. Joined on participant and case, so a participant
    with very many cases is spread by case."""
    first = rows.groupBy(participant, *within).agg(F.min(F.struct(*case)).alias("_f"))
    chosen = first.select(participant, *within, *[F.col(f"_f.{c}").alias(c) for c in case])
    # One row per key on the right: a semi-join would give the same rows, but is pushed below a union.
    return rows.join(chosen, [participant, *within, *case]).select(*rows.columns)


def match_participants(left: DataFrame, right: DataFrame, seed: int, comparison: str) -> DataFrame:
    """(split, healthy, lesion, pair_id): both sides in seeded order per split, zipped by rank."""

    people = left.select("split", "participant", F.lit(0).alias("side")).unionByName(
        right.select("split", "participant", F.lit(1).alias("side"))
    )
    stream = (F.lit(seed) + F.col("side") * SIDE_OFFSET + split_offset(F.col("split"))).cast("string")
    ranked = staged(draws.permuted(staged(people.distinct()), "participant", stream, ["split", "side"]))

    def one(side: int, name: str) -> DataFrame:
        return ranked.where(F.col("side") == side).select("split", "rank", F.col("participant").alias(name))

    matched = one(0, "healthy").join(one(1, "lesion"), ["split", "rank"])
    pair = scalars.stable_pair_id(comparison, F.col("split"), F.col("healthy"), F.col("lesion"))
    return matched.select("split", "healthy", "lesion", pair.alias("pair_id"))


def first_per_bin(rows: DataFrame, owner: Sequence[str], bin_col: str, cap: int, order: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows per owner and bin, in order. Spark limits such windows before the shuffle, so a bin with
    very many rows never reaches one task whole."""
    window = Window.partitionBy(*owner, bin_col).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= cap)


def balance_bins(numbered: DataFrame, pair: str, label: str, bin_col: str) -> DataFrame:
    """Rows of a pair such that both labels have min(cap, n₀, n₁) rows in every bin; at most 2·cap rows per window."""
    sides = Window.partitionBy(pair, bin_col)
    zero = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).over(sides)
    one = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(sides)
    return numbered.withColumn("_keep", F.least(zero, one)).where("_k <= _keep").drop("_k", "_keep")


def build_pairs(
    healthy: DataFrame, lesion: DataFrame, comparison: str = "healthy_vs_lesion", seed: int = 73, cap: int = 2
) -> Pairing:
    if cap not in (1, 2):
        raise ValueError("the cap per bin must be 1 or 2")
    matched = match_participants(healthy, lesion, seed, comparison)
    member = matched.select("pair_id", F.explode(F.array("healthy", "lesion")).alias("participant"))
    # One join for both sides: Spark pairs the partitions of a union of two joins on the same keys, and fails where
    # adaptive execution has cut one of them into more.
    both = healthy.withColumn("_side", F.lit(0)).unionByName(lesion.withColumn("_side", F.lit(1)))
    rows = primary_case(both, within=["_side"]).drop("_side")
    limited = first_per_bin(rows, ["participant", "label"], "z_bin", cap, ["z", "record_id"])
    records = balance_bins(limited.join(member, "participant"), "pair_id", "label", "z_bin")
    per_bin = records.where("label = 0").groupBy("pair_id", "z_bin").agg(F.count(F.lit(1)).alias("n"))
    histogram = per_bin.groupBy("pair_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("z_bin", "n")))).alias("z_histogram"),
        F.sum("n").alias("slice_count_per_domain"),
    )
    cases = records.groupBy("pair_id").agg(
        F.min(F.when(F.col("label") == 0, F.col("case_id"))).alias("healthy_case"),
        F.min(F.when(F.col("label") == 1, F.col("case_id"))).alias("lesion_case"),
    )
    pairs = matched.join(cases, "pair_id").join(histogram, "pair_id").withColumn("cap_per_bin", F.lit(cap))
    exclusions = (
        matched.join(records.select("pair_id").distinct(), "pair_id", "left_anti")
        .select("split", "healthy", "lesion", F.lit("no_common_z_bin").alias("reason"))
    )
    return Pairing(records, pairs, exclusions)


def flip_by_pair(df: DataFrame, seed, label: str = "label", pair: str = "pair_id", replicate: Column | None = None) -> DataFrame:
    """Swap both labels of a pair on a seeded coin: the coin is a function of the pair, so all rows agree."""
    parts = [F.col(pair)] if replicate is None else [replicate, F.col(pair)]
    bit = draws.hash_bit(seed, *parts).cast("int")
    return df.withColumn("flipped", bit).withColumn(label, F.col(label).bitwiseXOR(bit))


def shuffle_participant_labels(df: DataFrame, seed: int, participant: str = "participant", label: str = "label") -> DataFrame:
    """Permute labels between whole participants: the label of rank r goes to the id of rank r in another permutation."""
    people = df.select(participant, label).distinct()
    source = draws.permuted(people, participant, f"{seed}:labels", out="_r").select("_r", F.col(label).alias("_new"))
    target = draws.permuted(people.select(participant), participant, f"{seed}:ids", out="_r")
    mapping = target.join(source, "_r").select(participant, "_new")
    return attach(df, mapping, [participant]).withColumn(label, F.col("_new")).drop("_new")


def balanced_flip(df: DataFrame, seed: int, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """Flip exactly ⌊n/2⌋ pairs of each listed split; other splits stay as they are."""
    pairs = df.where(F.col("split").isin(list(splits))).select("split", "pair_id").distinct()
    sizes = pairs.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(draws.permuted(pairs, "pair_id", seed, ["split"], "_r"), sizes, ["split"])
    flips = ranked.where(F.col("_r") < F.floor(F.col("_n") / 2)).select("pair_id", F.lit(1).alias("flipped"))
    out = attach(df, flips, ["pair_id"], "left").withColumn("flipped", F.coalesce("flipped", F.lit(0)))
    return out.withColumn("label", F.col("label").bitwiseXOR(F.col("flipped")))


def case_partition(cases: DataFrame, source: str, case: str, share: float, seed: int) -> DataFrame:
    """First ⌊share·n⌋ cases of each source in seeded order explore, the rest confirm."""
    sizes = cases.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(draws.permuted(cases, case, seed, [source], "_r"), sizes, [source])
    part = F.when(F.col("_r") < F.floor(F.col("_n") * share), "explore").otherwise("confirm")
    return ranked.select(source, case, part.alias("partition"))


def experiment_plan(cohorts: DataFrame, modalities: Sequence[str], models: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every cohort × modality set × model × seed; the deterministic logistic model runs for the first seed only."""
    cells = [
        F.struct(F.lit(m).alias("modalities"), F.lit(k).alias("model"), F.lit(int(s)).alias("seed"))
        for m in modalities for k in models for s in (seeds[:1] if k == "logistic" else seeds)
    ]
    return cohorts.select("*", F.explode(F.array(*cells)).alias("_c")).select(*cohorts.columns, "_c.*")
