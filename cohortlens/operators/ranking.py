"""Ranking metrics and subject-level aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import draws, scalars
from cohortlens.functions.registry import Registry
from cohortlens.operators import confusion
from cohortlens.operators.scale import attach, banded, exact_quantiles, quantile_positions, running, staged


def ranked_ties(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None,
    sample_of: DataFrame | None = None,
) -> DataFrame:
    """Distinct scores per key with n, pos and their running counts from the highest score down.

    Equal scores form one group. The counts are computed by value bands, so neither the whole data set nor a hot key is
    sorted by one task.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    ties = df.groupBy(*keys, score).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(label).cast("int")).alias("pos")
    )
    if sample_of is None:
        ties = staged(ties)
    return running(banded(ties, score, sample_of), keys, [score], ["n", "pos"], descending=True)


def ranking(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None,
    extra: Sequence[Column] = (), sample_of: DataFrame | None = None, ties: DataFrame | None = None,
) -> DataFrame:
    """(keys, n, n_pos, ap, auc): non-interpolated average precision and tie-corrected ROC AUC.

    ``ap`` is NULL without positives and ``auc`` NULL with one class. ``extra`` are further aggregates over the ties.
    ``sample_of`` is a cheaper table with the same spread of scores, for choosing the bands. ``ties`` are those of
    ``ranked_ties`` where the caller has them already.
    """
    cum = ties if ties is not None else ranked_ties(df, keys, score, label, weight, sample_of)
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("n_total") - F.col("pos_total")) - (F.col("n_before") - F.col("pos_before")) - neg
    # Twice the Mann–Whitney count, as doubles: the product of two counts may not fit a BIGINT.
    twice_wins = F.col("pos").cast("double") * (2 * neg_below + neg)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    total = cum.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("n_pos"),
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(twice_wins).alias("_wins"),
        *extra,
    )
    p = F.col("n_pos").cast("double")
    return total.withColumns(
        {
            "ap": F.when(p > 0, F.col("_ap") / p),
            "auc": F.when((p > 0) & (F.col("n") > p), F.col("_wins") / (2.0 * p * (F.col("n") - p))),
        }
    ).drop("_ap", "_wins")


def average_precision(df: DataFrame, keys: Sequence[str] = (), empty: float | None = 0.0, score: str = "score") -> DataFrame:
    """Average precision of sanitized scores; ``empty`` is the value without positives (0 for voxels, NULL for subjects)."""
    clean = df.withColumn(score, scalars.sanitize(score))
    rows = ranking(clean, keys, score)
    return rows.select(*keys, "n", "n_pos", F.coalesce("ap", F.lit(empty).cast("double")).alias("ap"))


def sampled_average_precision(df: DataFrame, max_samples: int, seed: int, score: str = "score", exact_when_small: bool = False) -> DataFrame:
    """AP over ``max_samples`` draws with replacement, whatever the size of the data set; ``average_precision`` is exact.

    A caller may ask with ``exact_when_small`` for all elements where they are no more than the draws.

    The draws index the elements in (score, label) order. Any order gives the same law, and in this one elements of a
    tie are interchangeable: the ties are counted first and each draw is looked up in the tie that covers its position.
    Positions are cut to as many cells as there are draws, so the lookup is an equi-join with about one draw per cell.
    """
    clean = df.select(scalars.sanitize(score).alias(score), F.col("label").cast("int").alias("label"))
    total = clean.count()
    if not total or (exact_when_small and total <= max_samples):
        return average_precision(clean)
    ties = staged(clean.groupBy(score, "label").agg(F.count(F.lit(1)).alias("n")))
    placed = running(banded(ties, score), [], [score, "label"], ["n"])

    def cell(position: Column) -> Column:
        return F.floor(position * F.lit(float(max_samples)) / F.lit(float(total))).cast("long")

    end = F.col("n_before") + F.col("n")
    covered = placed.withColumn("_cell", F.explode(F.sequence(cell(F.col("n_before")), cell(end - 1))))
    drawn = (
        df.sparkSession.range(max_samples).select(draws.hash_index(total, seed, "id").alias("idx"))
        .groupBy("idx").agg(F.count(F.lit(1)).alias("w")).withColumn("_cell", cell(F.col("idx")))
    )
    hits = covered.join(drawn, "_cell").where((F.col("idx") >= F.col("n_before")) & (F.col("idx") < end))
    rows = ranking(hits.select(score, "label", "w"), [], score, "label", "w", sample_of=clean)
    return rows.select("n", "n_pos", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def checked_probability(probability: str = "score") -> Column:
    p = F.col(probability)
    return scalars.fail_unless(
        scalars.is_finite(p) & p.between(0.0, 1.0), p, "scores must be finite probabilities in [0, 1]"
    )


def cross_entropy(label: Column, p: Column) -> Column:
    q = scalars.clamp(p, 1e-7, 1.0 - 1e-7)
    return -(label * F.log(q) + (1 - label) * F.log1p(-q))


def binary_metrics(
    df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score", threshold: float = 0.5
) -> DataFrame:
    """One metric row per key; a probability equal to the threshold counts as positive."""
    rows = df.select(
        *keys,
        scalars.fail_unless(F.col(label).isin(0, 1), F.col(label).cast("int"), "labels must be 0 or 1").alias("label"),
        checked_probability(score).alias("score"),
    )
    # Everything is a function of (score, label), so one pass over the tie groups yields the whole row.
    hit, pos, neg = F.col("score") >= F.lit(threshold), F.col("pos"), F.col("n") - F.col("pos")
    loss = pos * cross_entropy(F.lit(1), F.col("score")) + neg * cross_entropy(F.lit(0), F.col("score"))
    extra = [
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(pos)).alias("fn"),
        (F.sum(loss) / F.sum("n")).alias("bce"),
    ]
    joined = ranking(rows, keys, extra=extra)
    rated = confusion.with_rates(joined)
    return rated.select(
        *keys,
        "n",
        F.col("n_pos").alias("n_positive"),
        (F.col("n") - F.col("n_pos")).alias("n_negative"),
        F.col("auc").alias("roc_auc"),
        F.col("ap").alias("average_precision"),
        "bce",
        ((F.col("tp") + F.col("tn")) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"),
        ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"),
        "sensitivity", "specificity", "tp", "tn", "fp", "fn",
    )


def aggregate_subjects(
    df: DataFrame, keys: Sequence[str] = (), method: str = "mean", participant: str = "participant", pair: str | None = "pair_id",
    label: str = "label", score: str = "probability",
) -> DataFrame:
    """One row per participant: label, score, pair and slice count. Conflicting labels or pairs stop the job.

    Means are rounded to 12 decimals: equal means must tie, whatever order a cluster summed them in.
    """
    if method not in ("mean", "median", "max"):
        raise ValueError(f"method must be mean, median or max, not {method!r}")
    by = [*keys, participant]
    low, high = F.min(label), F.max(label)
    aggs = [
        F.count(F.lit(1)).alias("slice_count"),
        F.when(low == high, low).otherwise(F.raise_error(F.lit("participant has conflicting labels"))).alias("label"),
    ]
    if pair:
        named = F.min(pair)
        whole = (named == F.max(pair)) & (F.count(pair) == F.count(F.lit(1)))
        aggs.append(
            F.when(whole, named).otherwise(F.raise_error(F.lit("participant maps to conflicting or missing pairs"))).alias(pair)
        )
    if method != "median":
        aggs.append((F.round(F.avg(score), 12) if method == "mean" else F.max(score)).alias("score"))
        return df.groupBy(*by).agg(*aggs)
    rows = df.groupBy(*by).agg(*aggs)
    return rows.join(exact_quantiles(df, by, score, {"score": 0.5}), by)


def slice_and_subject_metrics(df: DataFrame, keys: Sequence[str] = (), method: str = "mean") -> DataFrame:
    """The metric row of the slices and of the subjects, tagged by ``unit``."""
    slices = binary_metrics(df, keys, score="probability").withColumn("unit", F.lit("slice"))
    subjects = binary_metrics(aggregate_subjects(df, keys, method), keys).withColumn("unit", F.lit("subject"))
    return slices.unionByName(subjects)


def subject_balanced_loss(df: DataFrame, normalizer: float | None = None, score: str = "probability") -> DataFrame:
    """Cross-entropy where each participant has total weight one. The slice counts come from one aggregate, so the
    sum is taken per participant first and no row needs its participant's count joined to it."""
    per = df.groupBy("participant").agg(F.avg(cross_entropy(F.col("label"), F.col(score))).alias("l"))
    denominator = F.count(F.lit(1)) if normalizer is None else F.lit(float(normalizer))
    return per.agg((F.sum("l") / denominator).alias("loss"), F.count(F.lit(1)).alias("participants"))


def seed_ensemble(
    df: DataFrame, cell: Sequence[str], expected_seeds: Sequence[int], subject: str = "participant"
) -> tuple[DataFrame, DataFrame]:
    """Mean score per subject over the expected seeds, and the status of each cell.

    A cell passes only when every expected seed is present, no other seed is, and every subject occurs exactly once in
    every seed with one label. Cells that fail are reported and contribute no ensemble rows.
    """
    expected = F.array(*[F.lit(int(s)) for s in expected_seeds])
    count = len(expected_seeds)
    per_subject = df.groupBy(*cell, subject).agg(
        F.round(F.avg("score"), 12).alias("score"),
        F.min("label").alias("label"),
        F.min("pair_id").alias("pair_id"),
        F.count(F.lit(1)).alias("_rows"),
        F.collect_set("seed").alias("_seeds"),
        (F.min("label") == F.max("label")).alias("_one_label"),
    )
    whole = (
        (F.col("_rows") == count)
        & (F.size(F.array_intersect("_seeds", expected)) == count)
        & (F.size("_seeds") == count)
        & F.col("_one_label")
    )
    status = per_subject.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.count_if(~whole).alias("bad_subjects"),
        F.when(F.bool_and(whole), "PASS").otherwise("FAIL_CLOSED").alias("status"),
    )
    good = status.where("status = 'PASS'").select(*cell)
    return attach(per_subject.select(*cell, subject, "pair_id", "label", "score"), good, list(cell)), status


# name → function(value column, weight column or None) → aggregate Column
pooling: Registry[Callable[..., Column]] = Registry("aggregator")


@pooling.register("mean", "arithmetic", "arithmetic_mean")
def pool_mean(value: Column, weight: Column | None = None) -> Column:
    return F.avg(value)


@pooling.register("geometric", "gmean", "geometric_mean")
def pool_geometric(value: Column, weight: Column | None = None) -> Column:
    """exp(mean(ln x)); a zero gives −∞ and therefore 0, as Spark's own ln(0) would be NULL and silently skipped."""
    logged = F.when(value > 0, F.log(value)).when(value == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.exp(F.avg(logged))


@pooling.register("max", "maximum")
def pool_max(value: Column, weight: Column | None = None) -> Column:
    return F.max(value)


@pooling.register("sum")
def pool_sum(value: Column, weight: Column | None = None) -> Column:
    return F.sum(value)


@pooling.register("weighted_mean", "weighted")
def pool_weighted(value: Column, weight: Column | None = None) -> Column:
    if weight is None:
        raise ValueError("weighted_mean needs a weight")
    return F.sum(value * weight) / F.sum(weight)


def pool(df: DataFrame, keys: Sequence[str], value: str, method: str, out: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(pooling[method](F.col(value), F.col(weight) if weight else None).alias(out))


def pool_two_levels(df: DataFrame, element: Sequence[str], inner: str, value: str, first: str, second: str) -> DataFrame:
    """Pool over timesteps inside each ``inner`` group (a modality), then over the groups of an element."""
    once = pool(df, [*element, inner], value, first, "_v")
    return pool(once, element, "_v", second, "score")


def noise_schedule(spark, steps: int = 1000, start: float = 1e-4, end: float = 0.02) -> DataFrame:
    """(t, alpha, alpha_hat): linear schedule with its cumulative product, a dimension table of ``steps`` rows."""
    t = F.col("id")
    rows = spark.range(steps).select(
        t.alias("t"), (1 - (F.lit(start) + t * F.lit((end - start) / (steps - 1)))).alias("alpha")
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("alpha_hat", F.exp(F.sum(F.log("alpha")).over(upto)))


def selected_timesteps(lower: int, upper: int, count: int) -> list[int]:
    """Centres of ``count`` equal-width bins of [lower, upper)."""
    span = upper - lower
    if not 1 <= count <= span:
        raise ValueError("the number of timesteps must lie between 1 and the span")
    return [lower + ((2 * i + 1) * span) // (2 * count) for i in range(count)]


def residual_scores(df: DataFrame, schedule: DataFrame, timesteps: Sequence[int]) -> DataFrame:
    """Squared difference of posterior means from the true and the predicted noise, per kept timestep."""
    a, h = F.col("alpha"), F.col("alpha_hat")
    factor = schedule.select("t", ((1 - a) / (F.sqrt(1 - h) * F.sqrt(a))).alias("_c"))
    kept = df.where(F.col("t").isin(list(timesteps)))
    gap = F.col("eps") - F.col("eps_hat")
    # The schedule has a fixed number of rows (its steps), so broadcasting it is bounded.
    return kept.join(F.broadcast(factor), "t").withColumn("residual", F.pow(F.col("_c") * gap, 2)).drop("_c")
