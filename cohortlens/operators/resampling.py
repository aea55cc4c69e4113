"""Bootstrap, swap tests and multiplicity control (V1–V5).

Resampling works in rank space. The scores are ranked once; a replicate only changes how often each rank counts. The
counts of all replicates of a unit are one array, units lie in blocks of bounded size, and a block of ranks hands on its
positives, negatives and wins per replicate, which merge over the blocks. So there is no row per replicate and unit, and
no replicate is ever sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import draws, scalars
from cohortlens.operators.ranking import ranked_ties, ranking
from cohortlens.operators.scale import attach, banded, join_rows, parallelism, running, running_max, staged

#: Units, slots or ranks that one task holds at a time, with the counts of all replicates.
BLOCK = 1024
_COUNT = np.dtype("<u2")
#: Replicates whose draws are hashed together.
_TOGETHER = 16


def pair_table(subjects: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(keys, pair_id, s0, s1): one row per pair; a pair without exactly one subject of each class stops the job."""
    zero, one = F.col("label") == 0, F.col("label") == 1
    whole = (F.count(F.lit(1)) == 2) & (F.count_if(zero) == 1) & (F.count_if(one) == 1) & F.bool_and(F.col("pair_id") != "")
    checked = F.when(whole, F.max(F.when(zero, F.col(score)))).otherwise(
        F.raise_error(F.lit("a pair must hold exactly one subject of each class"))
    )
    return subjects.groupBy(*keys, "pair_id").agg(checked.alias("s0"), F.max(F.when(one, F.col(score))).alias("s1"))


def _units(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Number the resampling units of each key 0 … n−1 and add n."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = draws.permuted(df, unit, "units", keys, "_u")
    if keys:
        return attach(numbered, sizes, keys)
    return numbered.withColumn("_n", F.lit(sizes.first()[0]))


def _draws(sizes: DataFrame, keys: Sequence[str], replicates: int, seed) -> DataFrame:
    """(keys, _block, replicate, drawn): for each block of units, which of them a block of slots has drawn.

    Slot k of replicate b draws unit hash(seed, b, k) mod n. ``sizes`` has (keys, _n).
    """
    slots = sizes.select(*keys, F.col("_n").cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))).alias("_slots"))
    # The hash does not depend on the key: rows of the same slots and replicates of all keys follow each other and share it.
    rows = slots.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(_TOGETHER)))).repartition(
        4 * parallelism(sizes.sparkSession), "replicate", "_slots").sortWithinPartitions("replicate", "_slots")
    kept = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashed = None, None
        for batch in batches:
            source, block, replicate, drawn = [], [], [], []
            for i, (n, first, start) in enumerate(zip(*(batch.column(kept + c).to_pylist() for c in range(3)))):
                low = first * BLOCK
                if known != (first, start):
                    known = first, start
                    heads = [f"{seed}|{b}|".encode() for b in range(start, min(start + _TOGETHER, replicates + 1))]
                    hashed = draws.hash_grid(heads, [b"%d" % k for k in range(low, low + BLOCK)])
                for b, row in enumerate(hashed[:, :n - low], start):
                    units = np.sort(row % n)
                    cuts = np.flatnonzero(np.diff(units // BLOCK)) + 1
                    for part in np.split(units, cuts):
                        source.append(i)
                        block.append(int(part[0]) // BLOCK)
                        replicate.append(b)
                        drawn.append((part % BLOCK).astype(_COUNT).tobytes())
            of = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns[:kept], pa.array(block, pa.int64()), pa.array(replicate, pa.int32()), pa.array(drawn, pa.binary())], names=schema.names)

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_block", T.LongType()), T.StructField("replicate", T.IntegerType()), T.StructField("drawn", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _resampled(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], replicates: int, seed, emit: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``emit`` makes of each block of ``rows`` (keys, _u, …) and of how often its units are drawn.

    ``emit`` gets the rows and a table of counts with a row per row and a column per replicate; it returns the columns of
    ``schema``, to which the keys are added in front.
    """
    keys = list(keys)
    drawn = _draws(sizes, keys, replicates, seed)
    blocks = rows.withColumn("_block", F.floor(F.col("_u") / BLOCK))
    names = [*keys, *T.StructType.fromDDL(schema).names]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((BLOCK, replicates), np.int32)
        for b, units in zip(right["replicate"], right["drawn"]):
            counts[:, b - 1] += np.bincount(np.frombuffer(units, _COUNT), minlength=BLOCK).astype(np.int32)
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        out = emit(left, counts[left["_u"].to_numpy() % BLOCK])
        for at, k in enumerate(keys):
            out.insert(at, k, left[k].iloc[0])
        return out

    whole = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(schema).fields])
    by = [*keys, "_block"]
    return blocks.groupBy(*by).cogroup(drawn.groupBy(*by)).applyInPandas(run, whole)


RANKS = "rank long, label int, m binary"


def _by_rank(ranks: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Counts added up over equal (rank, label), so that a common score is a few rows however many units have it."""
    code = ranks * 2 + labels
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    sums = np.add.reduceat(counts[order], first, axis=0)
    return pd.DataFrame({"rank": found // 2, "label": (found % 2).astype(np.int32), "m": [x.astype(_COUNT).tobytes() for x in sums]})


def _with_ranks(base: DataFrame, ranks: DataFrame, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    """``base`` with the rank of each score column of ``names`` as a column of the given name."""
    for score, rank in names.items():
        base = base.join(ranks.select(*keys, F.col("score").alias(score), F.col("rank").alias(rank)), [*keys, score])
    return base


def _replicate_aucs(counted: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """(keys, replicate, auc) from (keys, rank, label, m); ranks grow from the highest score down."""
    keys = list(keys)
    parts = "_ranks long, replicate int, p double, n double, w double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ranks, at = np.unique(rows["rank"].to_numpy(), return_inverse=True)
        positive, negative = np.zeros((2, len(ranks), replicates))
        for i, label, m in zip(at, rows["label"], rows["m"]):
            (positive if label else negative)[i] += np.frombuffer(m, _COUNT)
        below = negative.sum(0) - np.cumsum(negative, 0)
        out = pd.DataFrame({"_ranks": int(rows["_ranks"].iloc[0]), "replicate": np.arange(1, replicates + 1, dtype=np.int32), "p": positive.sum(0), "n": negative.sum(0), "w": (positive * (2 * below + negative)).sum(0)})
        for i, k in enumerate(keys):
            out.insert(i, k, rows[k].iloc[0])
        return out

    schema = T.StructType([*(counted.schema[k] for k in keys), *T.StructType.fromDDL(parts).fields])
    blocks = counted.withColumn("_ranks", F.floor(F.col("rank") / BLOCK)).groupBy(*keys, "_ranks").applyInPandas(run, schema)
    # One row per block of ranks in a window.
    lower = Window.partitionBy(*keys, "replicate").orderBy(F.col("_ranks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("w") + 2 * F.col("p") * F.coalesce(F.sum("n").over(lower), F.lit(0.0))
    total = blocks.withColumn("w", wins).groupBy(*keys, "replicate").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*keys, "replicate", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (2.0 * F.col("p") * F.col("n"))).alias("auc"))


def _two_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    both = F.array(
        F.struct(F.lit(0).alias("label"), F.col("s0").alias("score")),
        F.struct(F.lit(1).alias("label"), F.col("s1").alias("score")),
    )
    return df.select(*keep, F.explode(both).alias("_x")).select(*keep, "_x.label", "_x.score")


def interval(replicate_aucs: DataFrame, keys: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Percentile interval over the valid replicates: their number is a parameter, so the groups are bounded."""
    alpha = (1.0 - confidence) / 2.0
    return replicate_aucs.groupBy(*keys).agg(
        F.count("auc").alias("n_valid"),
        F.percentile("auc", F.lit(alpha)).alias("ci_low"),
        F.percentile("auc", F.lit(1.0 - alpha)).alias("ci_high"),
    )


def _score_ranks(flat: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, score, rank) of the distinct scores, from the highest down, and (keys, observed_auc)."""
    ties = staged(ranked_ties(flat, keys))
    observed = ranking(flat, keys, ties=ties).select(*keys, F.col("auc").alias("observed_auc"))
    return ties.select(*keys, "score", F.col("n_before").alias("rank")), observed


def bootstrap_auc(subjects: DataFrame, keys: Sequence[str] = (), replicates: int = 2000, seed: int = 73, paired: bool = True) -> DataFrame:
    """(keys, observed_auc, n_valid, ci_low, ci_high, n_units): resample whole pairs, or subjects."""
    keys = list(keys)
    base = pair_table(subjects, keys) if paired else subjects.select(*keys, "participant", "label", "score")
    units = staged(_units(base, keys, "pair_id" if paired else "participant"))
    ranks, observed = _score_ranks(_two_rows(units, keys) if paired else units, keys)
    if paired:
        rows = _with_ranks(units, ranks, keys, {"s0": "r0", "s1": "r1"}).select(*keys, "_u", "r0", "r1")

        def emit(of: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
            return _by_rank(np.concatenate([of["r0"], of["r1"]]), np.repeat([0, 1], len(of)), np.concatenate([counts, counts]))
    else:
        rows = _with_ranks(units, ranks, keys, {"score": "r"}).select(*keys, "_u", "r", F.col("label").cast("int").alias("label"))

        def emit(of: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
            return _by_rank(of["r"].to_numpy(), of["label"].to_numpy(), counts)

    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    aucs = _replicate_aucs(_resampled(rows, sizes, keys, replicates, seed, emit, RANKS), keys, replicates)
    return join_rows(join_rows(observed, interval(aucs, keys), keys), sizes.withColumnRenamed("_n", "n_units"), keys)


def _swapped(pairs: DataFrame, keys: Sequence[str], swaps: int, seed) -> DataFrame:
    """(keys, rank, label, m) of ``pairs`` (keys, pair_id, r0, r1): a hashed coin per replicate exchanges the labels of a pair."""
    keys = list(keys)
    schema = T.StructType([*(pairs.schema[k] for k in keys), *T.StructType.fromDDL(RANKS).fields])

    heads = [f"{seed}|{b}|".encode() for b in range(1, swaps + 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                for key, of in frame[at:at + BLOCK].groupby(keys, dropna=False, sort=False) if keys else [((), frame[at:at + BLOCK])]:
                    coins = (draws.hash_grid(heads, [p.encode() for p in of["pair_id"]]) & 1).astype(np.int32).T
                    r0, r1 = of["r0"].to_numpy(), of["r1"].to_numpy()
                    out = _by_rank(np.concatenate([r0, r0, r1, r1]), np.repeat([1, 0, 1, 0], len(of)), np.concatenate([coins, 1 - coins, 1 - coins, coins]))
                    for i, (k, value) in enumerate(zip(keys, key)):
                        out.insert(i, k, value)
                    yield out

    return pairs.repartition(4 * parallelism(pairs.sparkSession), "pair_id").mapInPandas(run, schema)


def swap_test(subjects: DataFrame, keys: Sequence[str] = (), swaps: int = 1000, seed: int = 73) -> DataFrame:
    """Two-sided whole-pair label swap test on |AUC − ½| with the +1 correction."""
    keys = list(keys)
    pairs = staged(pair_table(subjects, keys))
    ranks, observed = _score_ranks(_two_rows(pairs, keys), keys)
    rows = _with_ranks(pairs, ranks, keys, {"s0": "r0", "s1": "r1"}).select(*keys, F.col("pair_id").cast("string").alias("pair_id"), "r0", "r1")
    null = _replicate_aucs(_swapped(rows, keys, swaps, seed), keys, swaps)
    n_pairs = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    # One observed row per key beside its bounded number of replicates.
    joined = join_rows(null, observed, keys)
    deviation = F.abs(F.col("observed_auc") - 0.5)
    extreme = F.count_if(F.abs(F.col("auc") - 0.5) >= deviation - 1e-15)
    out = joined.groupBy(*keys).agg(
        F.first("observed_auc").alias("observed_auc"),
        F.first(deviation).alias("deviation"),
        ((1 + extreme) / (1 + F.count("auc"))).alias("p_value"),
        F.count("auc").alias("n_valid"),
        F.when(F.count("auc") == swaps, "complete").otherwise("incomplete").alias("status"),
        F.avg("auc").alias("null_mean"),
        F.percentile("auc", F.lit(0.025)).alias("null_low"),
        F.percentile("auc", F.lit(0.975)).alias("null_high"),
    )
    return join_rows(out, n_pairs, keys)


def holm(df: DataFrame, family: Sequence[str], p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """Step-down adjustment inside each family of planned tests; a missing or non-finite p stays NULL.

    A family is a fixed list of hypotheses, so its window is small by design.
    """
    finite = scalars.is_finite(p)
    keys = [*family, "_finite"] if family else ["_finite"]
    flagged = df.withColumn("_finite", finite)
    ordered = Window.partitionBy(*keys).orderBy(p)
    whole = Window.partitionBy(*keys)
    # Equal p-values keep the larger step, as the running maximum gives both the same value.
    stepped = flagged.withColumn(
        "_step", F.least(F.lit(1.0), (F.count(F.lit(1)).over(whole) - F.row_number().over(ordered) + 1) * F.col(p))
    )
    running_max = F.max("_step").over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(out, F.when(F.col("_finite"), running_max)).drop("_finite", "_step")


def holm_large(df: DataFrame, family: Sequence[str], p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """``holm`` for families of any size: equal p-values are counted first and share the step of their first rank, and
    both the ranks and the running maximum are computed by bands."""
    keys = list(family)
    finite = df.where(scalars.is_finite(p))
    ties = staged(finite.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n")))
    ranked = staged(running(banded(ties, p), keys, [p], ["n"]))
    step = F.least(F.lit(1.0), (F.col("n_total") - F.col("n_before")) * F.col(p))
    stepped = running_max(banded(ranked.withColumn("_step", step), p), keys, [p], "_step", out)
    return attach(df, stepped.select(*keys, p, out), [*keys, p], "left")


def holm_if_complete(df: DataFrame, family: Sequence[str], expected: int, p: str = "p_value") -> DataFrame:
    """Holm only when the family has exactly the planned number of tests and all their p-values."""
    family = list(family)
    adjusted = holm_large(df, family, p) if family else holm(df, family, p)
    counts = df.groupBy(*family).agg(F.count(F.lit(1)).alias("_tests"), F.count_if(scalars.is_finite(p)).alias("_known"))
    joined = join_rows(adjusted, counts, family)
    complete = (F.col("_tests") == expected) & (F.col("_known") == expected)
    return joined.withColumns(
        {
            "family_status": F.when(complete, "PASS").otherwise("INCONCLUSIVE"),
            "p_holm": F.when(complete, F.col("p_holm")),
        }
    ).drop("_tests", "_known")


def case_bootstrap(df: DataFrame, cells: Sequence[str], group: str, contrast: tuple, replicates: int, seed: int, value: str = "value") -> DataFrame:
    """Difference of case-balanced means between two groups with a percentile interval.

    ``df`` has one mean per (case, cells, group). Every replicate draws the cases once, with the same multiplicities
    for both groups and all cells; a case missing from a group counts for the other one only.
    """
    first, second = contrast
    cells = list(cells)
    units = staged(_units(df.select("case_id").distinct(), [], "case_id"))
    both = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    rows = both.join(units.select("case_id", "_u"), "case_id").select("_u", *cells, (F.col(group) == F.lit(first)).alias("_first"), F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*(rows.schema[c] for c in cells), *T.StructType.fromDDL("_first boolean, replicate int, num double, den double").fields])

    def emit(of: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
        parts = []
        for key, at in of.groupby([*cells, "_first"], dropna=False, sort=False).indices.items():
            m = counts[at]
            sums = {"replicate": np.arange(1, replicates + 1, dtype=np.int32), "num": of["_v"].to_numpy()[at] @ m, "den": m.sum(0).astype(float)}
            parts.append(pd.DataFrame({**dict(zip([*cells, "_first"], key)), **sums}))
        return pd.concat(parts)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sums = _resampled(rows, units.groupBy().agg(F.count(F.lit(1)).alias("_n")), [], replicates, seed, emit, ddl)

    def mean(hit):
        num, den = F.sum(F.when(hit, F.col("num"))), F.sum(F.when(hit, F.col("den")))
        return F.coalesce(num, F.lit(0.0)) / F.greatest(F.coalesce(den, F.lit(0.0)), F.lit(1.0))

    boots = sums.groupBy(*cells, "replicate").agg((mean(F.col("_first")) - mean(~F.col("_first"))).alias("d"))
    ci = boots.groupBy(*cells).agg(
        F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high")
    )
    means = df.groupBy(*cells).agg(
        (F.avg(F.when(F.col(group) == F.lit(first), F.col(value))) - F.avg(F.when(F.col(group) == F.lit(second), F.col(value)))).alias("difference")
    )
    return means.join(ci, cells)
