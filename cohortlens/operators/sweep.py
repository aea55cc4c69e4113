"""Threshold lists and exact threshold sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import confusion
from cohortlens.operators.scale import bucket_by_cuts, parallelism


def threshold_list(start: float, end: float, step: float) -> list[float]:
    """Half-open list rounded to three decimals; order and duplicates are kept."""
    count = max(0, math.ceil((end - start) / step))
    return [round(start + i * step, 3) for i in range(count)]


def suffix_sums(size: int) -> Callable[[Column, Column], Column]:
    """Of the buckets of a key and their counts, the sums over bucket b and above for b = 1 … ``size``."""

    @F.pandas_udf("array<bigint>")
    def sums(buckets: pd.Series, counts: pd.Series) -> pd.Series:
        def one(at, n):
            held = np.zeros(size + 2, np.int64)
            held[np.asarray(at, np.int64)] = np.asarray(n, np.int64)
            return np.cumsum(held[size:0:-1])[::-1]

        return pd.Series([one(at, n) for at, n in zip(buckets, counts)], dtype=object)

    return sums


def sweep_counts(
    df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("subject",), score: str = "score", label: str = "label"
) -> DataFrame:
    """(keys, ord, thr, tp, tn, fp, fn) for every threshold from one pass over the elements.

    An element is counted once, in the bucket "number of cutoffs strictly below the score". Comparing strictly with a
    float32 cutoff is the same as comparing ≥ with the next float32, so a binary search over the successors gives the
    bucket. Suffix sums over at most len(thresholds)+1 buckets per key give the counts of every threshold.
    """
    if not thresholds or any(not math.isfinite(t) or abs(t) > float(np.finfo(np.float32).max) for t in thresholds):
        raise ValueError("thresholds must be a non-empty list of finite float32 values")
    cutoffs = np.asarray(list(thresholds), dtype=np.float32)
    with np.errstate(under="ignore"):
        following = np.nextafter(cutoffs, np.float32(np.inf))
    distinct = sorted({float(x) for x in following})
    position = {x: i + 1 for i, x in enumerate(distinct)}

    clean = df.select(*keys, scalars.sanitize(score).alias("_s"), F.col(label).cast("int").alias("_l"))
    bucketed = bucket_by_cuts(clean, "_s", distinct, "_bucket")
    counted = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_l").alias("pos"))

    # All buckets of a key, empty ones included, as arrays summed in the row: bounded by the number of thresholds. Rows of
    # thresholds are made last and go straight on; nothing sorts or holds a task's share of them.
    # The counts are small and dealt anew by key: left to their size, one task would make all rows. A count of
    # partitions of its own keeps the planner from leaving the step out.
    dealt = counted.repartition(2 * parallelism(df.sparkSession), *keys) if keys else counted
    present = dealt.groupBy(*keys).agg(F.collect_list(F.struct("_bucket", "n", "pos")).alias("_m"), F.sum("n").alias("_all"), F.sum("pos").alias("_allpos"))
    above = suffix_sums(len(distinct))
    summed = present.select(
        *keys, "_all", "_allpos",
        F.posexplode(F.arrays_zip(above(F.col("_m._bucket"), F.col("_m.n")).alias("predicted"), above(F.col("_m._bucket"), F.col("_m.pos")).alias("tp"))).alias("_at", "_sum"),
    ).select(*keys, "_all", "_allpos", (F.col("_at") + 1).alias("_bucket"), "_sum.predicted", "_sum.tp")
    # Thresholds by bucket: a bucket looks up its own, mostly one.
    own: list[list[Column]] = [[] for _ in distinct]
    for i, (t, x) in enumerate(zip(thresholds, following)):
        own[position[float(x)] - 1].append(F.struct(F.lit(i).alias("ord"), F.lit(float(t)).alias("thr")))
    listed = F.array(*[F.array(*each) for each in own])
    per_bucket = summed.withColumn("_t", F.explode(F.get(listed, F.col("_bucket") - 1)))
    fp = F.col("predicted") - F.col("tp")
    fn = F.col("_allpos") - F.col("tp")
    return per_bucket.select(
        *keys,
        F.col("_t.ord").alias("ord"),
        F.col("_t.thr").alias("thr"),
        "tp",
        (F.col("_all") - F.col("tp") - fp - fn).alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
    )


def sweep_counts_loop(
    df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("subject",), score: str = "score", label: str = "label"
) -> DataFrame:
    """The same counts by one conditional aggregate per threshold: the form that also takes mask steps, and the
    independent formulation the bucket form is tested against. Elements are not multiplied."""
    clean = df.select(*keys, scalars.sanitize(score).alias("_s"), F.col(label).alias("_l"))
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("_s") > F.lit(float(t)).cast("float")
        aggs += [F.count_if(hit & F.col("_l")).alias(f"tp{i}"), F.count_if(hit).alias(f"p{i}")]
    wide = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_l").alias("pos"), *aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(float(t)).alias("thr"),
                F.col(f"tp{i}").alias("tp"), F.col(f"p{i}").alias("p"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    long = wide.select(*keys, "n", "pos", F.explode(cells).alias("c"))
    fp, fn = F.col("c.p") - F.col("c.tp"), F.col("pos") - F.col("c.tp")
    return long.select(
        *keys, F.col("c.ord").alias("ord"), F.col("c.thr").alias("thr"), F.col("c.tp").alias("tp"),
        (F.col("n") - F.col("c.tp") - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"),
    )


def sweep_metrics(df: DataFrame, thresholds: Sequence[float], branch: Sequence[str] = ()) -> DataFrame:
    """Per threshold: macro Dice and micro sensitivity, specificity, precision."""
    counted = sweep_counts(df, thresholds, [*branch, "subject"])
    return confusion.macro_micro(counted, [*branch, "ord", "thr"])
