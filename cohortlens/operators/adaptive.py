"""Min-max normalization and per-subject adaptive thresholds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.functions.registry import Registry
from cohortlens.operators import confusion
from cohortlens.operators.scale import attach, attach_scalar, parallelism

HISTOGRAM_BINS = 256

# name → criterion Column over (w0, w1, s0, s1, q0, q1): counts, index sums and squared-count sums at or below / above
# a bin. The threshold is the centre of the first bin that maximizes it.
threshold_methods: Registry[Callable[[], Column]] = Registry("threshold method")


@threshold_methods.register("otsu")
def otsu() -> Column:
    """Between-class variance of the two sides."""
    gap = F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1")
    return F.col("w0").cast("double") * F.col("w1") * gap * gap


@threshold_methods.register("yen")
def yen() -> Column:
    """Exponential of the maximum-correlation criterion, so equal counts give bit-equal values."""
    p = F.col("w0") / (F.col("w0") + F.col("w1"))
    spread = p * (1.0 - p)
    return spread * spread / (F.col("q0").cast("double") * F.col("q1").cast("double"))


def normalize_minmax(df: DataFrame, scope: str = "subject", keys: Sequence[str] = ("subject",), eps: float = 1e-8) -> DataFrame:
    """(score − min) / max(max − min, eps) in float32, per subject or over the dataset."""
    if scope not in ("subject", "dataset"):
        raise ValueError(f"unknown normalization scope: {scope!r}")
    clean = df.withColumn("score", scalars.sanitize("score"))
    bounds = [F.min("score").alias("_lo"), F.max("score").alias("_hi")]
    if scope == "subject":
        ready = attach(clean, clean.groupBy(*keys).agg(*bounds), keys)
    else:
        ready = attach_scalar(clean, clean.agg(*bounds))
    width = F.greatest((F.col("_hi") - F.col("_lo")).cast("float"), F.lit(eps).cast("float"))
    scaled = ((F.col("score") - F.col("_lo")).cast("float") / width).cast("float")
    return ready.withColumn("score", scaled).drop("_lo", "_hi")


def adaptive_thresholds(df: DataFrame, method: str = "otsu", keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, thr) by a 256-bin histogram over [min, max] of each key. A constant key keeps its constant.

    Only the histogram (≤ 256 rows per key) is ever sorted; elements are reduced by partial aggregation.
    """
    criterion = threshold_methods[method]()
    clean = df.select(*keys, scalars.sanitize("score").cast("double").alias("_s"))
    ranges = clean.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    placed = attach(clean, ranges, keys).withColumn(
        "bin",
        F.when(F.col("_hi") == F.col("_lo"), 0)
        .otherwise(
            F.least(
                F.lit(HISTOGRAM_BINS - 1),
                F.floor((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * HISTOGRAM_BINS),
            )
        )
        .cast("int"),
    )
    hist = placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("c"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    # The histograms are small and dealt anew by key: left to their size, one task would sort them all. A count of partitions of
    # its own keeps the planner from leaving the step out.
    hist = hist.repartition(2 * parallelism(df.sparkSession), *keys) if keys else hist
    # Empty bins repeat the criterion of the bin before them, and the first maximum wins, so they can be left out.
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c, k = F.col("c"), F.col("bin").cast("long")
    # The square of a count may not fit a BIGINT.
    squared = F.col("c").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
    cum = hist.select(
        *keys, "bin", "_lo", "_hi",
        F.sum(c).over(upto).alias("w0"), F.sum(c * k).over(upto).alias("s0"), F.sum(squared).over(upto).alias("q0"),
        F.sum(c).over(whole).alias("_w"), F.sum(c * k).over(whole).alias("_s"), F.sum(squared).over(whole).alias("_q"),
    ).withColumns({"w1": F.col("_w") - F.col("w0"), "s1": F.col("_s") - F.col("s0"), "q1": F.col("_q") - F.col("q0")})
    scored = cum.withColumn("_crit", F.when(F.col("w1") > 0, criterion))
    best = F.max_by("bin", F.when(F.col("_crit").isNotNull(), F.struct(F.col("_crit"), -F.col("bin"))))
    picked = scored.groupBy(*keys).agg(best.alias("_b"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    centre = F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / HISTOGRAM_BINS
    return picked.select(*keys, F.coalesce(centre, F.col("_lo")).cast("float").alias("thr"))


def adaptive_counts(df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Confusion counts per key under each key's own threshold (strict >)."""
    joined = attach(df.select(*keys, "score", "label"), thresholds, keys)
    counted = joined.groupBy(*keys).agg(
        *confusion.counts(scalars.sanitize("score") > F.col("thr"), F.col("label")), F.first("thr").alias("thr")
    )
    return counted


def adaptive_summary(counted: DataFrame, branch: Sequence[str] = ()) -> DataFrame:
    """Mean threshold, macro Dice and micro rates."""
    return confusion.macro_micro(counted, list(branch), [F.avg(F.col("thr").cast("double")).alias("threshold")])
