"""Control gates, run summaries and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import resampling
from cohortlens.operators.scale import attach, quantile_positions, staged


def _known(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & scalars.is_finite(c)
    return out


def reduce_gate(rows: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Status of a gate over its seeds: a miss fails it, an unknown leaves it inconclusive."""
    judged = rows.withColumn("passed", passed)
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.count_if("passed").alias("n_passed"),
        scalars.status_of(~F.col("passed"), F.col("passed")).alias("status"),
    )


def tiny_gate(rows: DataFrame, keys: Sequence[str], min_accuracy: float = 0.99, max_bce: float = 0.02) -> DataFrame:
    met = (F.col("accuracy") >= min_accuracy) & (F.col("bce") <= max_bce)
    return reduce_gate(rows, keys, F.when(_known("accuracy", "bce"), met))


def positive_gate(rows: DataFrame, keys: Sequence[str], min_auc: float = 0.80, min_low: float = 0.50) -> DataFrame:
    met = (F.col("auc") >= min_auc) & (F.col("ci_low") > min_low)
    return reduce_gate(rows, keys, F.when(_known("auc", "ci_low"), met))


def negative_gate(
    rows: DataFrame, keys: Sequence[str], alpha: float = 0.01, deviation: float = 0.15, min_seeds: int = 2,
    band: tuple[float, float] = (0.35, 0.65), closeness: float = 0.60,
) -> DataFrame:
    """FAIL on a Holm-adjusted swap p below alpha or on reproducible deviations; PASS when every interval lies in the
    chance band and every swap test is complete; otherwise INCONCLUSIVE."""
    adjusted = resampling.holm(rows, keys, "p_value", "p_holm")
    gap = F.when(scalars.is_finite("deviation"), F.col("deviation")).otherwise(F.abs(F.col("auc") - 0.5))
    inside = F.when(_known("ci_low", "ci_high"), (F.col("ci_low") >= band[0]) & (F.col("ci_high") <= band[1]))
    ready = scalars.is_finite("p_value") & (F.col("swap_status") == "complete")
    upper = F.greatest(F.col("ci_high"), 1 - F.col("ci_low"))
    out = adjusted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.count_if(F.col("p_holm") < alpha).alias("p_failures"),
        F.count_if(gap >= deviation).alias("deviation_seeds"),
        F.bool_and(F.coalesce(inside, F.lit(False))).alias("ci_ready"),
        F.bool_and(F.coalesce(ready, F.lit(False))).alias("swap_ready"),
        F.bool_and(_known("auc", "ci_low", "ci_high")).alias("_known"),
        F.max(upper).alias("direction_invariant_upper"),
    )
    failed = (F.col("p_failures") > 0) | (F.col("deviation_seeds") >= min_seeds)
    status = F.when(failed, "FAIL").when(F.col("ci_ready") & F.col("swap_ready"), "PASS").otherwise("INCONCLUSIVE")
    close = (status == "PASS") & F.col("_known") & (F.col("direction_invariant_upper") < closeness)
    return out.withColumns(
        {"status": status, "closeness_status": F.when(close, "PASS").otherwise("INCONCLUSIVE")}
    ).drop("_known")


def direction_invariant(auc: str = "auc", low: str = "ci_low", high: str = "ci_high") -> dict[str, Column]:
    """AUC and interval independent of orientation: the union of the interval and its mirror, cut at one half."""
    a, lo, hi = F.col(auc), F.col(low), F.col(high)
    both = a.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return {
        "direction_auc": F.when(a.isNotNull(), F.greatest(a, 1 - a)),
        "direction_low": F.when(both, F.greatest(F.lit(0.5), F.least(lo, 1 - hi))),
        "direction_high": F.when(both, F.greatest(hi, 1 - lo)),
    }


def apply_gates(summary: DataFrame, controls: Sequence[str], upper: float = 0.60) -> DataFrame:
    """Control gate, low-separability and evidence status of run summary rows. ``controls`` are BOOLEAN columns where
    NULL stands for a missing control."""
    values = F.array(*[F.col(c) for c in controls])
    control = (
        F.when(F.exists(values, lambda v: v == F.lit(False)), "FAIL")
        .when(F.forall(values, lambda v: F.coalesce(v, F.lit(False))), "PASS")
        .otherwise("INCONCLUSIVE")
    )
    rows = summary.withColumns(direction_invariant()).withColumn("control_gate_status", control)
    passed = F.col("control_gate_status") == "PASS"
    low = (
        F.when(~passed | F.col("direction_high").isNull(), "INCONCLUSIVE")
        .when(F.col("direction_high") < upper, "PASS")
        .otherwise("FAIL")
    )
    evidence = F.when(F.col("auc").isNotNull() & passed, "COMPLETE").otherwise("INCONCLUSIVE")
    return rows.withColumns({"low_separability_status": low, "evidence_status": evidence})


def seed_statistics(subjects: DataFrame, keys: Sequence[str], replicates: int, swaps: int, seed: int = 73) -> DataFrame:
    """Bootstrap interval and swap test per key, one row each."""
    boot = resampling.bootstrap_auc(subjects, keys, replicates, seed)
    swap = resampling.swap_test(subjects, keys, swaps, seed).drop("observed_auc")
    return boot.withColumnRenamed("observed_auc", "auc").join(
        swap.select(*keys, "deviation", "p_value", F.col("status").alias("swap_status"), "n_pairs"), list(keys)
    )


def family_summary(cells: DataFrame, family: Sequence[str], expected: int) -> DataFrame:
    return resampling.holm_if_complete(cells, family, expected)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each row's value; ranks come from the tie table, so there is no global sort."""
    ties = quantile_positions(df, [], value)
    ranks = staged(ties.select(value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)))
    return attach(df, ranks, [value])


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of joined points with two-sided p-values; constant input gives NULL."""
    points = df.where(scalars.is_finite(x) & scalars.is_finite(y)).select(x, y)
    ranked = average_ranks(average_ranks(points, x, "_rx"), y, "_ry")
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # Rounding may push a perfect correlation past one.
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    out = ranked.agg(
        F.count(F.lit(1)).alias("points"),
        F.when(varied, unit(F.corr(x, y))).alias("pearson"),
        F.when(varied, unit(F.corr("_rx", "_ry"))).alias("spearman"),
    )
    return out.withColumns({f"{c}_p": scalars.correlation_p(F.col(c), F.col("points")) for c in ("pearson", "spearman")})


def trend(df: DataFrame, run: Sequence[str], order: str, metrics: Sequence[str], tolerance: float) -> DataFrame:
    """Change of each metric from the previous checkpoint, and PASS / PARTIAL_PASS by whether all / some held.

    A run has as many rows as it has checkpoints, so the window is small.
    """
    window = Window.partitionBy(*run).orderBy(order) if run else Window.partitionBy(F.lit(0)).orderBy(order)
    deltas = {f"{m}_delta": F.col(m) - F.lag(m).over(window) for m in metrics}
    rows = df.withColumns(deltas)
    held = [F.col(f"{m}_delta") >= -tolerance for m in metrics]
    every, some = held[0], held[0]
    for h in held[1:]:
        every, some = every & h, some | h
    first = F.col(f"{metrics[0]}_delta").isNull()
    return rows.withColumn(
        "status", F.when(first, "BASELINE").when(every, "PASS").when(some, "PARTIAL_PASS").otherwise("FAIL")
    )
