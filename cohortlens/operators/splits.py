"""Participant splits, folds, quotas and balanced resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators.scale import attach, banded, ordinals, staged

SPLITS = ("train", "val", "test")


def largest_remainder(weights: Sequence[float], total: int) -> list[int]:
    """Integer shares of ``total``: floors, then one more to the largest fractions, ties to the lower index."""
    scale = float(sum(weights))
    raw = [total * float(w) / scale for w in weights]
    base = [math.floor(r) for r in raw]
    order = sorted(range(len(raw)), key=lambda i: (-(raw[i] - base[i]), i))
    for i in order[: total - sum(base)]:
        base[i] += 1
    return base


def split_sizes(n: int, fractions: Sequence[float]) -> list[int]:
    """Largest-remainder sizes where, from three participants on, no requested split stays empty."""
    if len(fractions) != 3 or min(fractions) < 0 or not math.isclose(sum(fractions), 1.0):
        raise ValueError("fractions must be three non-negative numbers that sum to one")
    sizes = largest_remainder(fractions, n)
    if n >= 3:
        for i, f in enumerate(fractions):
            if f > 0 and sizes[i] == 0 and max(sizes) > 1:
                sizes[sizes.index(max(sizes))] -= 1
                sizes[i] += 1
    return sizes


def participant_split(
    ids: DataFrame, id_col: str, seed: int = 73, fractions: Sequence[float] = (0.70, 0.15, 0.15)
) -> DataFrame:
    """(id, split) for distinct ids: seeded permutation cut at the split sizes."""
    upto, cut = [], 0
    for size in split_sizes(ids.count(), fractions):
        cut += size
        upto.append(cut)
    ranked = draws.permuted(ids.select(id_col), id_col, seed)
    split = F.when(F.col("rank") < upto[0], SPLITS[0]).when(F.col("rank") < upto[1], SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select(id_col, split.alias("split"))


def apply_split_map(rows: DataFrame, mapping: DataFrame, participant: str = "participant") -> DataFrame:
    """Put every row of a participant in its split; a participant missing from the map stops the job."""
    joined = attach(rows, mapping.select(participant, F.col("split")), [participant], "left")
    checked = F.coalesce("split", F.raise_error(F.concat(F.lit("split map is missing participant "), F.col(participant).cast("string"))))
    return joined.withColumn("split", checked)


def extend_split_map(ids: DataFrame, existing: DataFrame, id_col: str, seed: int = 73) -> DataFrame:
    """Keep an existing map and split only the unknown ids."""
    unknown = ids.select(id_col).distinct().join(existing, id_col, "left_anti")
    known = existing.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return known.select(id_col, "split", F.lit(True).alias("kept")).unionByName(
        participant_split(unknown, id_col, seed).withColumn("kept", F.lit(False))
    )


def kfold(ids: DataFrame, id_col: str, folds: int, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """(fold, role, id): validation folds whose sizes differ by at most one; all other ids train."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    n = ids.count()
    if folds > n:
        raise ValueError(f"{folds} folds exceed {n} subjects")
    if shuffle:
        ranked = draws.permuted(ids.select(id_col), id_col, seed)
    else:
        ranked = ordinals(banded(ids.select(id_col), id_col), [], [id_col], "rank")
    base, extra = divmod(n, folds)
    rank = F.col("rank")
    big = extra * (base + 1)
    fold = F.when(rank < big, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - big) / max(base, 1)))
    assigned = ranked.select(id_col, fold.cast("int").alias("_own"))
    exploded = assigned.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("_own") == F.col("fold"), "validation").otherwise("train")
    return exploded.select("fold", role.alias("role"), id_col)


def repeated_split(train: DataFrame, test: DataFrame, id_col: str, repeats: int) -> DataFrame:
    if repeats < 1:
        raise ValueError("at least one repeat is needed")
    both = train.select(id_col, F.lit("train").alias("role")).unionByName(test.select(id_col, F.lit("test").alias("role")))
    return both.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("fold"), "role", id_col)


def rolling_test_windows(ids: DataFrame, id_col: str, folds: int, test_size: int, seed: int = 42) -> DataFrame:
    """Fold k tests positions [k·size, k·size + size) of the permutation, wrapping around."""
    n = ids.count()
    if folds < 2 or not 0 < test_size < n:
        raise ValueError("folds must be at least 2 and the test size between 1 and n − 1")
    ranked = draws.permuted(ids.select(id_col), id_col, seed)
    exploded = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    inside = F.pmod(F.col("rank") - F.col("fold") * test_size, F.lit(n)) < test_size
    return exploded.select("fold", F.when(inside, "test").otherwise("train").alias("role"), id_col)


def validation_split(ids: DataFrame, id_col: str, fraction: float, seed: int, rule: str = "round") -> DataFrame:
    n = ids.count()
    size = max(1, round(n * fraction)) if rule == "round" else max(1, math.ceil(n * fraction))
    ranked = draws.permuted(ids.select(id_col), id_col, seed)
    return ranked.select(id_col, F.when(F.col("rank") < size, "val").otherwise("train").alias("split"))


def global_ordinal(df: DataFrame, id_col: str, out: str = "slice_key") -> DataFrame:
    """Contiguous 0-based keys in id order, without a one-partition window."""
    return ordinals(banded(df, id_col), [], [id_col], out)


def _resample(df: DataFrame, group: str, id_col: str, seed, target: Column) -> DataFrame:
    """Whole copies of every row plus a seeded draw of the remainder, so each group has exactly ``target`` rows.

    ``target`` may use ``_n``, the group's row count. The rank inside the group is the seeded permutation, so the
    remainder are the rows of lowest rank: a sample without replacement. Copies are generated where the row lies.
    """
    # Written, the sizes are known to be few: a join planned without that deals all rows of a group to one task.
    sizes = staged(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    placed = attach(draws.permuted(df, id_col, seed, [group], "_r"), sizes, [group])
    sized = placed.withColumn("_t", target)
    copies = F.floor(F.col("_t") / F.col("_n")) + F.when(F.col("_r") < F.col("_t") % F.col("_n"), 1).otherwise(0)
    counted = sized.withColumn("_c", copies.cast("int")).where("_c > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))


def balance_by_level(df: DataFrame, level: str, id_col: str, target: int, seed: int) -> DataFrame:
    """Exactly ``target`` rows per level: sample if there are more, repeat and top up if there are fewer."""
    if target <= 0:
        raise ValueError("the target per level must be positive")
    rows = _resample(df, level, id_col, seed, F.lit(int(target)))
    full = F.floor(F.lit(int(target)) / F.col("_n"))
    return rows.select(
        *df.columns,
        F.col("_n").alias("balance_count"),
        F.col("copy").alias("duplicate_copy_id"),
        ((F.col("_n") <= target) & (F.col("copy") >= full)).alias("is_extra_sample"),
    )


def quotas(weights: DataFrame, bucket: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder quota per bucket. ``weights`` is the reference histogram: one row per bucket."""
    everything = Window.partitionBy(F.lit(0))
    raw = weights.select(bucket, weight, (F.lit(total) * F.col(weight) / F.sum(weight).over(everything)).alias("_raw"))
    base = raw.withColumns({"_base": F.floor("_raw"), "_frac": F.col("_raw") - F.floor("_raw")})
    rest = F.lit(total) - F.sum("_base").over(everything)
    order = F.row_number().over(everything.orderBy(F.desc("_frac"), F.col(bucket)))
    return base.select(
        bucket, weight, (F.col("_base") + F.when(order <= rest, 1).otherwise(0)).cast("long").alias("quota")
    )


def draw_by_quota(df: DataFrame, bucket: str, id_col: str, quota: DataFrame, seed: int) -> DataFrame:
    """Fill each bucket to its quota: whole copies, then a sample without replacement; numbered copies per source row."""
    known = attach(df, staged(quota.select(bucket, F.col("quota").alias("_quota"))), [bucket])
    rows = _resample(known, bucket, id_col, seed, F.col("_quota"))
    return rows.select(*df.columns, (F.col("copy") + 1).alias("duplicate_sequence"))


def stratified_sample(df: DataFrame, case: str, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per case without replacement; a case with fewer rows is drawn with replacement."""
    sizes = df.groupBy(case).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(draws.permuted(df, id_col, seed, [case], "_r"), sizes, [case])
    enough = ranked.where(F.col("_n") >= n).where(F.col("_r") < n).withColumn("slot", F.col("_r"))
    slots = sizes.where(F.col("_n") < n).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    picks = slots.select(case, "slot", draws.hash_index(F.col("_n"), seed, case, "slot").alias("_r"))
    short = ranked.where(F.col("_n") < n).join(picks, [case, "_r"])
    return enough.select(*df.columns, "slot").unionByName(short.select(*df.columns, "slot"))


def tiny_set(df: DataFrame, participant: str, label: str, per_label: int, cap: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``per_label`` participants of each label; their rows in order, at most ``cap`` in all while each keeps one.

    Taking row 1 of every participant, then row 2 of every participant and so on, keeps at least one row each. ``cap``
    is the feature here (a small overfitting set), and the filter on the row number limits the windows map-side. A cap
    below the number of chosen participants stops the job, as does a label with fewer participants than wanted.
    """
    people = df.select(participant, label).distinct()
    ranked = draws.permuted(people, participant, seed, [label], "_r").where(F.col("_r") < per_label)
    # At most per_label rows of each label.
    found = {r[label]: r["n"] for r in ranked.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(found.values()) > cap or any(n < per_label for n in found.values()):
        raise ValueError(f"{per_label} participants of each label within {cap} rows: found {found}")
    chosen = attach(df, ranked.select(participant), [participant], "left_semi")
    numbered = chosen.withColumn("_k", F.row_number().over(Window.partitionBy(participant).orderBy(*order)))
    first = numbered.where(F.col("_k") <= cap)
    kept = first.orderBy("_k", label, participant).limit(cap)
    return kept.drop("_k")


def order_map(column: str, values: Sequence[str]) -> Column:
    """Sort key of a categorical column in a fixed order."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))

