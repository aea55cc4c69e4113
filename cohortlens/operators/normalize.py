"""Intensity normalization and distribution matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators.scale import (
    attach, attach_scalar, banded, exact_quantile_grid, exact_quantiles, grid_of_ranks, quantile_positions, running, staged,
)
from cohortlens.operators.summaries import histogram_bin

BACKGROUND = -1.0


def p99_scale(df: DataFrame, keys: Sequence[str], value: str, out: str, eps: float = 1e-8) -> DataFrame:
    """Divide by the 99th percentile of the positive values; a group without any stays unchanged."""
    tops = exact_quantiles(df.where(F.col(value) > 0), keys, value, {"_p99": 0.99})
    ready = attach(df, tops, keys, "left")
    return ready.withColumn(out, F.col(value) / F.coalesce(F.greatest("_p99", F.lit(eps)), F.lit(1.0))).drop("_p99")


def p99_clip(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Divide by the 99th percentile of the nonzero values and clip to [0, 1]; zero stays zero."""
    tops = exact_quantiles(df.where(F.col(value) != 0), keys, value, {"_p99": 0.99})
    ready = attach(df, tops, keys, "left")
    top = scalars.fail_unless(F.col("_p99") > 0, F.col("_p99"), "no positive 99th percentile")
    return ready.withColumn(out, scalars.clamp(F.col(value) / top, 0.0, 1.0)).drop("_p99")


def robust_iqr(df: DataFrame, keys: Sequence[str], value: str, foreground: Column, out: str, eps: float = 1e-8) -> DataFrame:
    """(v − median) / IQR on the foreground, −1 elsewhere; the statistics stay in the row."""
    stats = exact_quantiles(df.where(foreground), keys, value, {"_q1": 0.25, "median": 0.5, "_q3": 0.75})
    stats = stats.select(*keys, "median", (F.col("_q3") - F.col("_q1")).alias("iqr"))
    ready = attach(df, stats, keys, "left")
    width = scalars.fail_unless(F.col("iqr") > eps, F.col("iqr"), "degenerate interquartile range")
    return ready.withColumn(out, F.when(foreground, (F.col(value) - F.col("median")) / width).otherwise(BACKGROUND))


def mean_std(df: DataFrame, keys: Sequence[str], value: str, foreground: Column, out: str, background: float = BACKGROUND, eps: float = 1e-8) -> DataFrame:
    """(v − mean) / population deviation on the foreground, ``background`` elsewhere."""
    stats = df.where(foreground).groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    ready = attach(df, stats, keys, "left")
    width = scalars.fail_unless(F.col("_sd") > eps, F.col("_sd"), "degenerate deviation")
    return ready.withColumn(out, F.when(foreground, (F.col(value) - F.col("_m")) / width).otherwise(background)).drop("_m", "_sd")


def equalize(df: DataFrame, keys: Sequence[str], value: str, out: str, bins: int = 256) -> DataFrame:
    """Histogram equalization of the positive values: CDF at bin centres, linearly interpolated; others become 0."""
    fg = F.col(value) > 0
    tops = df.groupBy(*keys).agg(F.max(value).alias("_top"), F.min(F.when(fg, F.col(value))).alias("_low"))
    scaled = attach(df, tops, keys).withColumns({"_v": F.col(value) / F.col("_top"), "_lo": F.col("_low") / F.col("_top")})
    inside = scaled.where(fg).withColumn("_bin", histogram_bin(F.col("_v"), F.col("_lo"), F.lit(1.0), bins))
    hist = inside.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    # Dense CDF: `bins` rows per key.
    dense = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_h"), F.sum("_c").alias("_n"))
    dense = dense.select(*keys, "_h", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_k"))
    upto = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    cdf = dense.select(*keys, "_k", (F.sum(F.coalesce(F.try_element_at("_h", F.col("_k")), F.lit(0))).over(upto) / F.col("_n")).alias("_cdf"))
    cdf = staged(cdf)
    width = (F.lit(1.0) - F.col("_lo")) / bins
    place = (F.col("_v") - F.col("_lo")) / width - 0.5
    low = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(place))).cast("int")
    high = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(place) + 1)).cast("int")
    ranked = scaled.withColumns({"_kl": low, "_kh": high, "_t": scalars.clamp(place - F.floor(place), 0.0, 1.0)})
    a = cdf.select(*keys, F.col("_k").alias("_kl"), F.col("_cdf").alias("_a"))
    b = cdf.select(*keys, F.col("_k").alias("_kh"), F.col("_cdf").alias("_b"))
    both = attach(attach(ranked, a, [*keys, "_kl"], "left"), b, [*keys, "_kh"], "left")
    mapped = F.when(fg, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).otherwise(0.0)
    return both.select(*df.columns, mapped.alias(out))


def positive_or_fail(value: str) -> Column:
    v = F.col(value)
    return scalars.fail_unless(scalars.is_finite(v) & (v > 0), v, "landmarks need finite positive values")


def landmarks(df: DataFrame, keys: Sequence[str], value: str, intervals: int = 4096) -> DataFrame:
    """Quantile landmarks of positive finite values; other values and degenerate groups stop the job."""
    ranked = quantile_positions(df.withColumn(value, positive_or_fail(value)), keys, value)
    # A group is constant if one distinct value has all its rows: told in the row, without a join of landmarks.
    varied = scalars.fail_unless(F.col("n") < F.col("n_total"), F.col(value), "landmarks of a constant group")
    return grid_of_ranks(ranked.withColumn(value, varied), keys, value, intervals)


def reference_curve(df: DataFrame, case: Sequence[str], group: Sequence[str], value: str, intervals: int = 4096) -> DataFrame:
    """Mean landmark over cases, each case weighing the same: (group, i, q)."""
    return landmarks(df, [*case, *group], value, intervals).groupBy(*group, "i").agg(F.avg("q").alias("q"))


def quantile_map(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, target_keys: Sequence[str] = (), intervals: int = 4096) -> DataFrame:
    """(keys, value, n, mapped) for the distinct foreground values: monotone map of own landmarks onto the target's.

    Tied source landmarks take the mean of their targets. A value whose first position is s lies between landmarks
    ⌊s·K/(N−1)⌋ and the next one, so the bracket is an equi-join on (key, landmark index). That splits a hot key into K
    parts and needs no range join.
    """
    return monotone_map(df.withColumn(value, positive_or_fail(value)), keys, value, target, target_keys, intervals)


def monotone_map(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, target_keys: Sequence[str] = (), intervals: int = 4096) -> DataFrame:
    """``quantile_map`` for values of any sign; null values have no row."""
    v = F.col(value)
    ranked = staged(quantile_positions(df, keys, value))
    own = grid_of_ranks(ranked, keys, value, intervals).withColumnRenamed("q", "x")
    paired = own.join(target.withColumnRenamed("q", "_y"), [*target_keys, "i"])
    knots = staged(paired.select(*keys, "i", "x", F.avg("_y").over(Window.partitionBy(*keys, "x")).alias("y")))
    last = F.greatest(F.col("n_total") - 1, F.lit(1))
    placed = ranked.withColumn("i", F.floor(F.col("n_before") * F.lit(intervals) / last).cast("int"))
    left = knots.select(*keys, "i", F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    right = knots.select(*keys, (F.col("i") - 1).alias("i"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    both = placed.join(left, [*keys, "i"]).join(right, [*keys, "i"], "left")
    mapped = (
        F.when(v <= F.col("_x0"), F.col("_y0"))
        .when(F.col("_x1").isNull() | (v >= F.col("_x1")), F.coalesce("_y1", "_y0"))
        .otherwise(scalars.interpolate(v, F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1")))
    )
    return both.select(*keys, value, "n", mapped.alias("mapped"))


def apply_map(df: DataFrame, keys: Sequence[str], value: str, mapping: DataFrame, out: str) -> DataFrame:
    """Replace foreground (positive) values by their mapped value, leave the background untouched, and fail on a
    foreground value that the map does not have."""
    joined = attach(df, mapping.select(*keys, value, F.col("mapped").alias("_m")), [*keys, value], "left")
    kept = scalars.fail_unless(~(F.col(value) > 0), F.col(value).cast("double"), "foreground value without a mapping")
    return joined.withColumn(out, F.coalesce("_m", kept)).drop("_m")


def distribution_distance(values: DataFrame, keys: Sequence[str], value: str, target: DataFrame, intervals: int, weight: str | None = None) -> DataFrame:
    """Largest CDF error on the target's landmarks and the Wasserstein distance on that grid over the target's IQR.

    ``target`` is (keys, i, q). The CDF at a landmark is the running count of values ≤ it: landmarks enter the banded
    running sum as rows of weight zero that sort after equal values.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    ties = values.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.sum(w).alias("n"))
    ties = ties.select(*keys, "v", "n", F.lit(-1).alias("i"))
    grid = target.select(*keys, F.col("q").cast("double").alias("v"), F.lit(0).cast("long").alias("n"), F.col("i").cast("int").alias("i"))
    both = ties.unionByName(grid)
    cum = running(banded(both, "v"), keys, ["v", "i"], ["n"])
    cdf = cum.where("i >= 0").select(*keys, "i", F.col("v").alias("q"), (F.col("n_before") / F.col("n_total")).alias("f"))
    error = F.abs(F.col("f") - F.col("i") / F.lit(intervals))
    # intervals + 1 rows per key.
    order = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("i")
    steps = cdf.withColumn("_e", error).withColumn(
        "_area", (F.col("_e") + F.lag("_e").over(order)) / 2 * (F.col("q") - F.lag("q").over(order))
    )
    quarter = [intervals // 4, 3 * intervals // 4]
    iqr = F.max(F.when(F.col("i") == quarter[1], F.col("q"))) - F.max(F.when(F.col("i") == quarter[0], F.col("q")))
    return steps.groupBy(*keys).agg(F.max("_e").alias("cdf_max_error"), (F.sum("_area") / iqr).alias("wasserstein_over_iqr"))


def train_standardizer(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Standardize with the mean and deviation of the training rows only; a deviation ≤ 1e-12 counts as 1."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}")]
    ready = attach_scalar(df, staged(df.where(F.col(split) == "train").agg(*aggs)))
    for f in features:
        sd = F.when(F.col(f"_s_{f}") <= 1e-12, 1.0).otherwise(F.col(f"_s_{f}"))
        ready = ready.withColumn(f, (F.col(f) - F.col(f"_m_{f}")) / sd)
    return ready.select(*df.columns)


def train_scale(df: DataFrame, value: str, split: str = "split", p: float = 0.995, floor: float = 1e-6) -> DataFrame:
    """One shared scale: the quantile of |v| over the training rows, at least ``floor``."""
    sizes = df.where(F.col(split) == "train").select(F.abs(F.col(value)).alias("_a"))
    return exact_quantiles(sizes, [], "_a", {"q": p}).select(F.greatest("q", F.lit(floor)).alias("scale"))


def align(source: DataFrame, target: DataFrame, keys: Sequence[str], value: str, methods: Sequence[str], eps: float = 1e-8, intervals: int = 100) -> DataFrame:
    """The source's values moved onto the target's distribution per key, one column per method: shift of the median, scale
    of the interquartile range, both (median, iqr, median_iqr), or ``quantile``, the monotone map of ``intervals`` + 1 quantiles, in which
    tied source quantiles take the mean of their targets. A degenerate range keeps its scale. A key without target values has nulls."""
    levels = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    own = exact_quantiles(source, keys, value, {f"_s{n}": p for n, p in levels.items()})
    other = exact_quantiles(target, keys, value, {f"_t{n}": p for n, p in levels.items()})
    ready = attach(source, own.join(other, list(keys), "left"), keys, "left")
    if "quantile" in methods:
        mapping = monotone_map(source, keys, value, exact_quantile_grid(target, keys, value, intervals), keys, intervals)
        ready = attach(ready, mapping.select(*keys, value, F.col("mapped").alias("_mapped")), [*keys, value], "left")
    width = F.col("_sq3") - F.col("_sq1")
    scale = F.when(width <= eps, 1.0).otherwise((F.col("_tq3") - F.col("_tq1")) / width)
    v = F.col(value)
    moved = {
        "median": v + F.col("_tq2") - F.col("_sq2"),
        "iqr": (v - F.col("_sq2")) * scale + F.col("_sq2"),
        "median_iqr": (v - F.col("_sq2")) * scale + F.col("_tq2"),
        "quantile": F.col("_mapped"),
    }
    unknown = [m for m in methods if m not in moved]
    if unknown:
        raise ValueError(f"unknown alignment: {unknown}")
    return ready.select(*source.columns, *[moved[m].alias(m) for m in methods])
