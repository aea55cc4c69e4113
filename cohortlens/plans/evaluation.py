"""The evaluation plan: normalized scores → adaptive threshold and fixed sweep → one metric table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import adaptive, sweep
from cohortlens.operators.scale import staged


def evaluate_elements(df: DataFrame, thresholds: Sequence[float], method: str = "otsu") -> DataFrame:
    """(metric, thr, dice, sensitivity, precision): one row per fixed threshold and one for the adaptive method."""
    # Scores are stored once and read by each step with pruned columns; changing the method reuses them.
    scored = staged(adaptive.normalize_minmax(df).select("subject", "score", "label"))
    rates = [F.round(c, 9).alias(c) for c in ("dice", "sensitivity", "precision")]
    fixed = sweep.sweep_metrics(scored, thresholds).select(F.lit("sweep").alias("metric"), "thr", *rates)
    per_subject = adaptive.adaptive_counts(scored, adaptive.adaptive_thresholds(scored, method))
    own = adaptive.adaptive_summary(per_subject).select(
        F.lit(method).alias("metric"), F.round("threshold", 7).alias("thr"), *rates
    )
    return fixed.unionByName(own)
