"""Distribution summaries, histograms, divergences and comparison tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import scalars
from cohortlens.functions import draws
from cohortlens.operators.scale import attach, attach_scalar, exact_quantile_grid, banded, exact_quantiles, join_rows, quantile_positions, running, staged

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def finite_or_fail(value: str) -> Column:
    return scalars.fail_unless(scalars.is_finite(value), F.col(value), f"{value} holds a missing or non-finite number")


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Mean, population deviation, extremes and interpolated percentiles; non-finite input stops the job."""
    checked = df.select(*keys, finite_or_fail(value).alias(value))
    moments = checked.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    quantiles = exact_quantiles(checked, keys, value, dict(percentiles), count="count")
    return join_rows(moments, quantiles, keys)


def small_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, min, max and population deviation of the present values; NULLs where there are none."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
    )
    medians = exact_quantiles(df, keys, value, {"median": 0.5})
    return join_rows(base, medians, keys, "left")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """The value at 1-based rank ⌈p·n⌉, found on the tie table."""
    ranked = quantile_positions(df, keys, value)
    rank = F.ceil(F.col("n_total") * p) - 1
    hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    return ranked.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(out))


def moments(df: DataFrame, keys: Sequence[str], value: str, eps: float = 1e-12) -> DataFrame:
    """Mean, std, skewness and Pearson (non-excess) kurtosis; the last two are 0 where the variance vanishes."""
    out = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("_v"),
        F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"),
    )
    varied = F.col("_v") > eps
    return out.select(
        *keys, "mean", "std",
        F.when(varied, F.col("_s")).otherwise(0.0).alias("skewness"),
        F.when(varied, F.col("_k") + 3).otherwise(0.0).alias("kurtosis"),
    )


def variation(df: DataFrame, location: Sequence[str], value: str, eps: float = 1e-8) -> DataFrame:
    """Mean, population deviation and coefficient of variation std / (mean + eps) at each location."""
    return df.groupBy(*location).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn(
        "cv", F.col("std") / (F.col("mean") + eps)
    )


# The near-zero levels a variation report counts.
CV_LEVELS = (1e-6, 1e-4, 1e-3, 1e-2)


def share_below(column: str, level: float) -> Column:
    return 100.0 * F.avg((F.col(column) < level).cast("int"))


def channel_correlations(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Correlation of every pair of channels inside each sample, in long form."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1:]]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs])
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.a", "_c.b", "_c.r")


def pairwise_cosine(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Count, mean and deviation of the cosine over all unordered pairs, without forming a pair.

    With unit vectors u: Σ cos = (‖Σu‖² − n) / 2 and Σ cos² = (‖Σ u uᵀ‖² − n) / 2 over pairs. Each Arrow batch is reduced
    to its sums of u and u uᵀ, so the work is linear in the rows and one group may be arbitrarily large.
    """
    plain = df.select(F.to_json(F.struct(*keys)).alias("g") if keys else F.lit("{}").alias("g"), F.col(vector).alias("px"))

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, (n, s, m) in sums.items():
                cells = pa.array([np.concatenate([s, m.ravel()]).tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({"g": [g], "n": [n], "v": cells})
            sums.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if len(sums) > 64:
                yield from flush()
            groups = np.asarray(batch.column(0).to_pylist(), dtype=object)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, -1)
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for g in set(groups.tolist()):
                part = u[groups == g]
                total = sums.setdefault(g, [0, np.zeros(u.shape[1]), np.zeros((u.shape[1], u.shape[1]))])
                total[0] += part.shape[0]
                total[1] += part.sum(axis=0)
                total[2] += part.T @ part
        yield from flush()

    partial = plain.mapInArrow(reduce_batches, "g string, n long, v array<double>")
    cells = partial.select("g", "n", F.posexplode("v").alias("i", "v"), F.size("v").alias("_len"))
    summed = cells.groupBy("g", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("_len").alias("_len"))
    # len = d + d², so d is its integer root: the first d cells are Σu.
    d = F.floor((F.sqrt(4 * F.col("_len") + 1) - 1) / 2 + 1e-9)
    first = F.col("i") < d
    rows = summed.groupBy("g").agg(
        F.max("n").alias("n"),
        F.sum(F.when(first, F.col("v") * F.col("v"))).alias("_s1"),
        F.sum(F.when(~first, F.col("v") * F.col("v"))).alias("_s2"),
    )
    n = F.col("n")
    pairs = n * (n - 1) / 2
    mean = (F.col("_s1") - n) / 2 / pairs
    square = (F.col("_s2") - n) / 2 / pairs
    parsed = rows.withColumn("_g", F.from_json("g", df.select(*keys).schema)) if keys else rows
    return parsed.select(
        *[F.col(f"_g.{k}").alias(k) for k in keys],
        pairs.cast("long").alias("pairs"), mean.alias("mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
    )


#: Vectors of a block of the pairwise schedule; equal-width bins of [-1, 1] for the first count.
COSINE_BLOCK, COSINE_BINS = 256, 1 << 16


def _block_cosines(a: Sequence, b: Sequence, same: bool) -> np.ndarray:
    """Cosines of the pairs of two blocks, rounded to 12 decimals so that machines agree on them."""
    units = []
    for block in (a, b):
        x = np.array([np.asarray(v, dtype=np.float64) for v in block])
        units.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    cosines = np.round(np.clip(units[0] @ units[1].T, -1.0, 1.0), 12)
    return cosines[np.triu_indices(len(units[0]), k=1)] if same else cosines.ravel()


def _cosine_bins(c: np.ndarray) -> np.ndarray:
    return np.minimum((c + 1.0) / 2.0 * COSINE_BINS, COSINE_BINS - 1).astype(np.int32)


def pairwise_cosine_quantiles(df: DataFrame, keys: Sequence[str], id_col: str, vector: str, probabilities: Mapping[str, float], seed: int = 0) -> DataFrame:
    """Interpolated quantiles of the cosines of all unordered pairs of a key: (keys, pairs, one column per probability).

    Rows are cut into blocks in hashed order, and each pair of blocks of the upper triangle is one row of work, so no task
    sees more than two blocks at a time. A first pass counts cosines per bin; a second one keeps only the values in the bins that wanted
    ranks fall into, counted by value, and ranks them. No pair is written as a row. Ids are unique per key; null vectors are left out, zero
    vectors have cosine 0, and a key with fewer than two vectors has no row.
    """
    keys = list(keys)
    ranked = draws.permuted(df.where(F.col(vector).isNotNull()).select(*keys, id_col, vector), id_col, seed, keys, "_r")
    blocks = staged(ranked.groupBy(*keys, F.floor(F.col("_r") / COSINE_BLOCK).cast("int").alias("_j")).agg(F.collect_list(vector).alias("_b")))
    sizes = blocks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_blocks"))
    first = attach(blocks, sizes, keys).select(*keys, F.col("_j").alias("_i"), F.col("_b").alias("_a"), F.explode(F.sequence(F.col("_j"), F.col("_blocks") - 1)).alias("_j"))
    pairs = first.join(blocks, [*keys, "_j"]).select(*keys, "_a", "_b", (F.col("_i") == F.col("_j")).alias("_same"))
    schema = T.StructType([df.schema[k] for k in keys]).add("_bin", T.IntegerType())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                bins, n = np.unique(_cosine_bins(_block_cosines(row[-3], row[-2], row[-1])), return_counts=True)
                yield pd.DataFrame({**dict(zip(keys, row)), "_bin": bins, "_n": n})

    binned = pairs.mapInPandas(count, T.StructType(list(schema)).add("_n", T.LongType())).groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    # At most COSINE_BINS rows a key.
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(binned.select("*", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("pairs")))

    def ranks(p: float) -> tuple[Column, Column]:
        low = F.floor((F.col("pairs") - 1) * F.lit(float(p)))
        return low, F.least(low + 1, F.col("pairs") - 1)

    wanted = F.lit(False)
    for p in probabilities.values():
        for rank in ranks(p):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    hit = staged(placed.where(wanted))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                cosines = _block_cosines(row[-4], row[-3], row[-2])
                values, n = np.unique(cosines[np.isin(_cosine_bins(cosines), row[-1])], return_counts=True)
                yield pd.DataFrame({**dict(zip(keys, row)), "_bin": _cosine_bins(values), "_v": values, "n": n})

    narrowed = attach(pairs, hit.groupBy(*keys).agg(F.collect_list("_bin").alias("_bins")), keys)
    kept = narrowed.mapInPandas(keep, T.StructType(list(schema)).add("_v", T.DoubleType()).add("n", T.LongType()))
    ties = staged(kept.groupBy(*keys, "_bin", "_v").agg(F.sum("n").alias("n")))
    inside = running(banded(ties, "_v"), [*keys, "_bin"], ["_v"], ["n"]).join(hit.select(*keys, "_bin", "_before", "pairs"), [*keys, "_bin"])
    start = F.col("_before") + F.col("n_before")
    picks = []
    for name, p in probabilities.items():
        picks += [F.max(F.when((start <= rank) & (rank < start + F.col("n")), F.col("_v"))).alias(f"_{end}_{name}") for end, rank in zip(("lo", "hi"), ranks(p))]
    rows = inside.groupBy(*keys).agg(F.max("pairs").alias("pairs"), *picks)
    out = []
    for name, p in probabilities.items():
        place = (F.col("pairs") - 1) * F.lit(float(p))
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place - F.floor(place))).alias(name))
    return rows.select(*keys, "pairs", *out)


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of [low, high] with the last edge inclusive; a degenerate range has one bin."""
    place = F.floor((value - low) / (high - low) * bins)
    return F.when(high > low, F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))).otherwise(0).cast("int")


def shared_histogram(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Counts per group on common edges over the global range, with the total each group must add up to."""
    ready = attach_scalar(df, df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    placed = ready.withColumn("bin", histogram_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins))
    counted = placed.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(group)
    return counted.withColumn("total", F.sum("count").over(whole))


def unit_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Counts per tenth of [0, 1]; a value outside stops the job."""
    checked = scalars.fail_unless(F.col(value).between(0.0, 1.0), F.col(value), f"{value} must lie in [0, 1]")
    placed = df.withColumn("bin", histogram_bin(checked, F.lit(0.0), F.lit(1.0), bins))
    return placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))


def nearest_to_midpoints(df: DataFrame, value: str, case: str, per_bin: int, bins: int = 10) -> DataFrame:
    """``per_bin`` cases nearest to each bin's midpoint; ties prefer the higher value, then the smaller id. The rank
    limit is applied before the shuffle, so a full bin is never collected."""
    placed = df.withColumn("bin", histogram_bin(F.col(value), F.lit(0.0), F.lit(1.0), bins))
    # Distance rounded so that mirror-image values tie as they do on paper.
    distance = F.round(F.abs(F.col(value) - (F.col("bin") + 0.5) / bins), 12)
    window = Window.partitionBy("bin").orderBy(distance, F.desc(value), case)
    return placed.withColumn("pick", F.row_number().over(window)).where(F.col("pick") <= per_bin)


def two_level_mean(df: DataFrame, case: Sequence[str], group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of case means, so that each case weighs the same."""
    means = df.groupBy(*case, *group).agg(*[F.avg(v).alias(v) for v in values])
    return means.groupBy(*group).agg(F.count(F.lit(1)).alias("cases"), *[F.avg(v).alias(v) for v in values])


def mutual_information(df: DataFrame, keys: Sequence[str], a: str, b: str, bins: int = 64, minimum: int = 32) -> DataFrame:
    """Mutual information (nats) of a bins × bins joint histogram; 0 below ``minimum`` finite points."""
    clean = df.where(scalars.is_finite(a) & scalars.is_finite(b)).select(*keys, a, b)
    ranges = clean.groupBy(*keys).agg(
        F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"), F.count(F.lit(1)).alias("_n")
    )
    ready = attach(clean, ranges, keys) if keys else attach_scalar(clean, ranges)
    placed = ready.select(
        *keys, "_n",
        histogram_bin(F.col(a), F.col("_a0"), F.col("_a1"), bins).alias("_i"),
        histogram_bin(F.col(b), F.col("_b0"), F.col("_b1"), bins).alias("_j"),
    )
    joint = placed.groupBy(*keys, "_i", "_j").agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("n"))
    # At most bins² cells per key from here on.
    row, col = Window.partitionBy(*keys, "_i"), Window.partitionBy(*keys, "_j")
    cells = joint.select(*keys, "c", "n", F.sum("c").over(row).alias("ci"), F.sum("c").over(col).alias("cj"))
    term = F.col("c") / F.col("n") * F.log(F.col("c").cast("double") * F.col("n") / (F.col("ci").cast("double") * F.col("cj")))
    out = cells.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(term).alias("_mi"))
    return out.select(*keys, "n", F.when(F.col("n") < minimum, 0.0).otherwise(F.col("_mi")).alias("mutual_information"))


def profile_divergence(profiles: DataFrame, keys: Sequence[str], bin_col: str, mass: str, reference: DataFrame, frequency: Column) -> DataFrame:
    """Jensen–Shannon divergence in bits, cosine, centroid and low / high shares of a profile against a reference.

    A profile has one row per radial bin, so windows and joins here are small.
    """
    floor = F.lit(1e-30)
    p = profiles.select(*keys, bin_col, (F.col(mass) / F.sum(mass).over(Window.partitionBy(*keys))).alias("p"))
    q = reference.select(bin_col, (F.col(mass) / F.sum(mass).over(Window.partitionBy(F.lit(0)))).alias("q"))
    both = p.join(q, bin_col).withColumn("m", (F.col("p") + F.col("q")) / 2).withColumn("f", frequency)

    def half(c: str) -> Column:
        return 0.5 * F.sum(F.col(c) * F.log2(F.greatest(F.col(c), floor) / F.greatest(F.col("m"), floor)))

    return both.groupBy(*keys).agg(
        (half("p") + half("q")).alias("js_bits"),
        (F.sum(F.col("p") * F.col("q")) / (F.sqrt(F.sum(F.col("p") * F.col("p"))) * F.sqrt(F.sum(F.col("q") * F.col("q"))))).alias("cosine"),
        F.sum(F.col("p") * F.col("f")).alias("centroid"),
        F.sum(F.when(F.col("f") <= 0.1, F.col("p")).otherwise(0.0)).alias("low_share"),
        F.sum(F.when(F.col("f") >= 0.25, F.col("p")).otherwise(0.0)).alias("high_share"),
    )


def weighted_mixture_check(parts: DataFrame, mixed: DataFrame, bin_col: str, value: str, count: str, tolerance: float) -> DataFrame:
    """Does the count-weighted mean of the source spectra equal the spectrum of the mixture, bin by bin?"""
    expected = parts.groupBy(bin_col).agg((F.sum(F.col(count) * F.col(value)) / F.sum(count)).alias("expected"))
    both = expected.join(mixed.select(bin_col, F.col(value).alias("observed")), bin_col, "full_outer")
    gap = F.abs(F.col("observed") - F.col("expected")) / F.greatest(F.abs(F.col("expected")), F.lit(1e-30))
    return both.withColumn("ok", F.coalesce(gap <= tolerance, F.lit(False)))


def paired_difference(joined: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """MAE, RMSE, bias, correlation, means and deviations of two variants of the same elements."""
    gap = F.col(b) - F.col(a)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(gap).alias("bias"), F.corr(a, b).alias("correlation"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_pop(a).alias("std_a"), F.stddev_pop(b).alias("std_b"),
    )


def quantile_error(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, intervals: int, out: str) -> DataFrame:
    """Mean distance of a key's quantiles at i / intervals from the reference curve (i, q)."""
    grid = exact_quantile_grid(df, keys, value, intervals).join(target.select("i", F.col("q").alias("_target")), "i")
    return grid.groupBy(*keys).agg(F.avg(F.abs(F.col("q") - F.col("_target"))).alias(out))


def foreground_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shares of values above 0, 0.02 and 1; mean and percentiles of the positive ones (null without any)."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        *[F.avg((v > limit).cast("int")).alias(n) for n, limit in (("positive", 0), ("above_002", 0.02), ("above_one", 1))], F.avg(F.when(v > 0, v)).alias("positive_mean"))
    q = exact_quantiles(df.where(v > 0), keys, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    return base.join(q, list(keys), "left")


def depth_histogram(df: DataFrame, keys: Sequence[str], depth: str, slices: int = 155, inner: tuple[int, int] = (50, 100)) -> DataFrame:
    """Rows per depth 0 … slices − 1 as one array, and the share of rows in [inner). A depth outside stops the job."""
    z = scalars.fail_unless((F.col(depth) >= 0) & (F.col(depth) < slices), F.col(depth), f"depth outside 0 to {slices - 1}")
    per = df.groupBy(*keys, z.cast("int").alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    inside = (F.col("_z") >= inner[0]) & (F.col("_z") < inner[1])
    out = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("_in"), F.map_from_entries(F.collect_list(F.struct("_z", "_n"))).alias("_h"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.coalesce(F.try_element_at("_h", i), F.lit(0)))
    return out.select(*keys, "n", (F.col("_in") / F.col("n")).alias("inner_share"), counts.alias("histogram"))


def level_sample(df: DataFrame, keys: Sequence[str], depth: str, levels: Sequence[int], per_level: int, id_col: str, seed: int) -> DataFrame:
    """``per_level`` rows of every key at each of the depths, without replacement; a level with fewer gives what it has."""
    at = df.where(F.col(depth).isin(*levels))
    return draws.permuted(at, id_col, seed, [*keys, depth], "_r").where(F.col("_r") < per_level).drop("_r")


def quantile_ratio(df: DataFrame, keys: Sequence[str], value: str, kept: Column, p: float, out: str) -> DataFrame:
    """Quantile of all values of a key over that of its kept values; null where nothing is kept."""
    whole = exact_quantiles(df, keys, value, {"_all": p})
    part = exact_quantiles(df.where(kept), keys, value, {"_part": p})
    return whole.join(part, list(keys), "left").select(*keys, (F.col("_all") / F.col("_part")).alias(out))


def stage_timing(df: DataFrame, stage: str, value: str) -> DataFrame:
    base = df.groupBy(stage).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    medians = exact_quantiles(df, [stage], value, {"median": 0.5})
    return base.join(medians, stage).join(nearest_rank(df, [stage], value, 0.95, "p95"), stage)


def timing_overview(timings: DataFrame, runs: DataFrame, run: Sequence[str], subject: str, seconds: str, hit: str, wall: str) -> DataFrame:
    """One row per run of an evaluation: what its stages, subjects and the rest took.

    ``timings`` is (run, subject, seconds, hit): a row without subject is shared work of the run. ``runs`` is (run, wall).
    A subject is a cache hit if any of its rows says so; its total is the sum of its stages, and count, mean, median and nearest-rank
    95th percentile are over these totals. Overhead is wall time outside all stages. A run without timings has zeros and nulls.
    """
    run = list(run)
    per = timings.groupBy(*run, subject).agg(F.sum(seconds).alias("_s"), F.bool_or(hit).alias("_hit"))
    own, shared = F.col(subject).isNotNull(), F.col(subject).isNull()
    whole = per.groupBy(*run).agg(
        F.count_if(own & ~F.coalesce("_hit", F.lit(False))).alias("inferred"), F.count_if(own & F.col("_hit")).alias("cache_hits"),
        F.sum("_s").alias("stage_seconds"), F.coalesce(F.sum(F.when(shared, F.col("_s"))), F.lit(0.0)).alias("shared_seconds"), F.avg(F.when(own, F.col("_s"))).alias("subject_mean"))
    totals = per.where(own)
    out = runs.join(whole, run, "left").join(exact_quantiles(totals, run, "_s", {"subject_median": 0.5}), run, "left").join(nearest_rank(totals, run, "_s", 0.95, "subject_p95"), run, "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("inferred", "cache_hits")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("stage_seconds", "shared_seconds")}
    ready = out.withColumns(zeros).withColumn("overhead_seconds", F.col(wall) - F.col("stage_seconds"))
    return ready.select(*run, wall, "inferred", "cache_hits", "stage_seconds", "shared_seconds", "overhead_seconds", "subject_mean", "subject_median", "subject_p95")


def learning_curve(df: DataFrame, run: Sequence[str], epoch: str, train: str, validation: str, last: int = 20) -> DataFrame:
    """Final values, first minimum of the validation loss, means of the last and the previous ``last`` epochs.

    A run has one row per epoch, so ranking inside a run is small.
    """
    order = Window.partitionBy(*run).orderBy(F.desc(epoch))
    ranked = df.withColumn("_k", F.row_number().over(order))
    recent, before = F.col("_k") <= last, (F.col("_k") > last) & (F.col("_k") <= 2 * last)
    out = ranked.groupBy(*run).agg(
        F.max_by(train, epoch).alias("final_train"), F.max_by(validation, epoch).alias("final_validation"),
        F.min(validation).alias("best_validation"), F.min(F.struct(validation, epoch)).getField(epoch).alias("best_epoch"),
        F.avg(F.when(recent, F.col(validation))).alias("last_mean"), F.avg(F.when(before, F.col(validation))).alias("previous_mean"),
    )
    return out.withColumn("reduction_percent", 100.0 * (F.col("previous_mean") - F.col("last_mean")) / F.col("previous_mean"))
