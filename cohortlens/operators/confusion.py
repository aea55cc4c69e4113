"""Confusion counts, rates and the Dice family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators.scale import exact_quantiles


def counts(predicted: Column, label: Column) -> list[Column]:
    """TP, TN, FP, FN as aggregates."""
    return [
        F.count_if(predicted & label).alias("tp"),
        F.count_if(~predicted & ~label).alias("tn"),
        F.count_if(predicted & ~label).alias("fp"),
        F.count_if(~predicted & label).alias("fn"),
    ]


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(*counts(predicted, F.col(label)))


def sensitivity() -> Column:
    return scalars.ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def specificity() -> Column:
    return scalars.ratio(F.col("tn"), F.col("tn") + F.col("fp"))


def precision() -> Column:
    return scalars.ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def count_dice(both_empty: float = 0.0) -> Column:
    return scalars.dice(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), both_empty)


def with_rates(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {"sensitivity": sensitivity(), "specificity": specificity(), "precision": precision()}
    )


def macro_micro(per_subject: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Macro Dice (mean over subjects) beside micro rates (pooled counts)."""
    pooled = per_subject.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg(count_dice()).alias("dice"),
        *[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")],
        *extra,
    )
    return with_rates(pooled)


def gated_by_labels(metrics: DataFrame, has_labels: Column, columns: Sequence[str]) -> DataFrame:
    """Label metrics become NULL unless every subject of the dataset carries labels."""
    return metrics.withColumns({c: F.when(has_labels, F.col(c)) for c in columns})


def best_threshold(sweep: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """First threshold with the maximum Dice."""
    best = F.max_by(F.struct("thr", "dice"), F.struct(F.col("dice"), -F.col(order)))
    return sweep.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.thr").alias("best_thr"), F.col("_b.dice").alias("best_dice")
    )


def model_summary(cases: DataFrame, model: str) -> DataFrame:
    """Mean and median of per-case precision, recall and Dice beside the pooled rates and totals."""
    rated = cases.withColumns({"p": precision(), "r": sensitivity(), "d": count_dice()})
    means = [F.avg(c).alias(f"mean_{n}") for c, n in (("p", "precision"), ("r", "recall"), ("d", "dice"))]
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    base = rated.groupBy(model).agg(F.count(F.lit(1)).alias("cases"), *means, *sums)
    names = {"p": "median_precision", "r": "median_recall", "d": "median_dice"}
    long = rated.unpivot(model, list(names), "rate", "v")
    medians = exact_quantiles(long, [model, "rate"], "v", {"median": 0.5})
    wide = medians.groupBy(model).agg(*[F.max(F.when(F.col("rate") == k, F.col("median"))).alias(n) for k, n in names.items()])
    return base.join(wide, model).withColumns(
        {
            "pooled_precision": scalars.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "pooled_recall": scalars.ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def mask_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], element: Sequence[str]) -> DataFrame:
    """Overlap of two masks given as tables of positive elements, per key."""
    a = left.select(*keys, *element, F.lit(1).alias("a"))
    b = right.select(*keys, *element, F.lit(1).alias("b"))
    both = a.join(b, [*keys, *element], "full_outer")
    out = both.groupBy(*keys).agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("intersection"),
        F.count(F.lit(1)).alias("union"),
        F.count_if(F.col("b").isNull()).alias("a_only"),
        F.count_if(F.col("a").isNull()).alias("b_only"),
    )
    n = F.col("intersection")
    return out.withColumns(
        {
            "dice": scalars.dice(n, n + F.col("a_only"), n + F.col("b_only"), both_empty=1.0),
            "jaccard": F.when(F.col("union") == 0, 1.0).otherwise(n / F.col("union")),
        }
    )
