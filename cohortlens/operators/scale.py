"""Exact building blocks that keep one hot key from landing in one task.

Everything here returns whole results. What changes is only where the rows are processed:

* ``banded`` cuts an ordering into value bands of about equal row counts, so a running sum or rank over a key holding
  a third of all rows is computed by many tasks. A band is a function of the value, hence stable under task retry.
* ``running`` and ``ordinals`` add the totals of earlier bands to the sums inside a band.
* ``exact_quantiles`` reads order statistics off those running counts instead of buffering a group.
* ``attach`` joins one row of statistics per key to the detail rows and leaves broadcasts and hot keys to the planner.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

BAND = "_band"
_scope: ContextVar[list[str] | None] = ContextVar("staged folders", default=None)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that one task sorts or joins at a time.
ROWS_AT_ONCE = 1 << 18


def tasks_for(df: DataFrame) -> int:
    """Number of tasks that have about ``ROWS_AT_ONCE`` rows each, for ``repartition`` before a sort or a join.

    The planner joins partitions by their compressed size. Keys of text shrink so much there that a task would have to sort
    millions of rows; a number that is given is kept. ``df`` is counted: a stored table, or one that is cheap to derive.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_AT_ONCE))


def staged(df: DataFrame) -> DataFrame:
    """Write a derived table once to the shared checkpoint folder and read it back.

    For a table several later steps read: it cuts the lineage, survives the loss of executors, keeps column pruning
    and gives the planner the real size.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging_scope() -> Iterator[list[str]]:
    """The folders that ``staged`` writes inside the block, for ``empty_folder`` once their results are written elsewhere."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def empty_folder(spark: SparkSession, path: str) -> None:
    """Free the space of a staged table that nothing reads any more: an empty table takes its place."""
    spark.range(0).write.mode("overwrite").parquet(path)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key statistics to detail rows.

    A plain equi-join: the planner broadcasts a side whose measured size is small, and adaptive execution splits the
    detail rows of a hot key; nothing is copied for keys that are not hot.
    """
    return df.join(stats, list(keys), how)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as a scalar subquery: evaluated once, no join."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    held = df.withColumn("_row", row)
    return held.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in one_row.columns])


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two results that have one row per key; without keys both are single rows."""
    return left.join(right, list(keys), how) if keys else attach_scalar(left, right)


def bucket_by_cuts(df: DataFrame, column: str, cuts: Sequence[float], out: str) -> DataFrame:
    """``out`` = number of cuts ≤ value, found by binary search on the JVM."""
    ordered = sorted({float(cut) for cut in cuts})
    if not ordered:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *ordered, float("inf")]
    name = f"_d_{out}"
    doubled = df.withColumn(name, F.col(column).cast("double"))
    found = Bucketizer(splits=splits, inputCol=name, outputCol=out, handleInvalid="keep").transform(doubled)
    return found.withColumn(out, F.col(out).cast("int")).drop(name)


def banded(df: DataFrame, column: str, sample_of: DataFrame | None = None) -> DataFrame:
    """Add a band number that grows with ``column`` (numeric) and splits the rows about evenly.

    The cuts are approximate quantiles of the rows that will be sorted, or of ``sample_of``, a smaller table with the
    same spread. They decide balance only; results do not depend on them.
    """
    count = parallelism(df.sparkSession)
    probe = (df if sample_of is None else sample_of).select(F.col(column).cast("double").alias("v"))
    probabilities = [i / count for i in range(1, count)]
    cuts = probe.approxQuantile("v", probabilities, 1.0 / (4 * count))
    return bucket_by_cuts(df, column, [c for c in cuts if math.isfinite(c)], BAND)


def by_band(local: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the totals of earlier bands to rows that a window has dealt and sorted by key and band.

    With many keys the totals are as many as keys times bands, which the size of the files does not tell: they are merged
    where the rows lie, never sent through the driver.
    """
    return local.join(offsets.hint("merge") if keys else offsets, [*keys, BAND])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    descending: bool = False,
    following: str | None = None,
) -> DataFrame:
    """Add ``<name>_before`` (exclusive running sum inside the key) and ``<name>_total`` for each name.

    The input carries ``_band`` and at most one row per (keys, order); the output has no band. ``following`` names the
    first column of an ascending order: its next value inside the key is added as ``<following>_next``.
    """
    if following is not None and (descending or order[0] != following):
        raise ValueError("the next value follows the first column of an ascending order")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = (
        Window.partitionBy(*keys, BAND)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per key and band: at most `parallelism` rows per key.
    per_key = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    earlier = per_key.orderBy(direction(BAND)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = [] if following is None else [F.min(following).alias("_first")]
    totals = df.groupBy(*keys, BAND).agg(*[F.sum(s).alias(s) for s in sums], *firsts)
    offsets = totals.select(
        *keys,
        BAND,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(per_key).alias(f"{s}_total") for s in sums],
        *[F.lead("_first").over(per_key.orderBy(BAND)).alias("_later") for _ in firsts],
    )
    ahead = [F.lead(following).over(Window.partitionBy(*keys, BAND).orderBy(*order)).alias("_ahead") for _ in firsts]
    local = df.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums], *ahead)
    joined = by_band(local, offsets, keys)
    for s in sums:
        joined = joined.withColumn(f"{s}_before", F.col(f"_in_{s}") + F.col(f"_off_{s}"))
    if following is not None:
        joined = joined.withColumn(f"{following}_next", F.coalesce("_ahead", "_later"))
    return joined.drop(BAND, "_ahead", "_later", *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums])


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Inclusive running maximum in ascending order, by bands like ``running``."""
    inside = Window.partitionBy(*keys, BAND).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_key = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    earlier = per_key.orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, BAND).agg(F.max(value).alias("_top"))
    offsets = tops.select(*keys, BAND, F.max("_top").over(earlier).alias("_off"))
    local = df.withColumn("_in", F.max(value).over(inside))
    joined = by_band(local, offsets, keys)
    return joined.withColumn(out, F.greatest("_in", "_off")).drop("_in", "_off", BAND)


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "ordinal") -> DataFrame:
    """Add the 0-based position in ``order`` inside the key. The input carries ``_band``, monotone in ``order``."""
    inside = Window.partitionBy(*keys, BAND).orderBy(*order)
    per_key = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    earlier = per_key.orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, BAND).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, BAND, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = df.withColumn("_in", F.row_number().over(inside) - 1)
    return by_band(local, offsets, keys).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off", BAND)


def quantile_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their positions and the next value: (keys, value, n, n_before, n_total, <value>_next).

    The tie counts are written once: the input is evaluated a single time, and the bands are cut on the rows that are
    actually sorted, so neither repeated values nor long tails unbalance them.
    """
    ties = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    return running(banded(ties, value), keys, [value], ["n"], following=value)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    count: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probabilities``.

    No task ever holds a whole group: values are tie-grouped, ranked band by band, and the two order statistics around
    each position are picked by a plain aggregate.
    """
    ranked = quantile_positions(df, keys, value)
    start, end, total = F.col("n_before"), F.col("n_before") + F.col("n"), F.col("n_total")
    picks = [F.max("n_total").alias("_n")]
    for name, p in probabilities.items():
        low = F.floor((total - 1) * F.lit(float(p)))
        high = F.least(low + 1, total - 1)
        picks.append(F.max(F.when((start <= low) & (low < end), F.col(value))).cast("double").alias(f"_lo_{name}"))
        picks.append(F.max(F.when((start <= high) & (high < end), F.col(value))).cast("double").alias(f"_hi_{name}"))
    rows = ranked.groupBy(*keys).agg(*picks)
    out = []
    for name, p in probabilities.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        fraction = position - F.floor(position)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * fraction).alias(name))
    extra = [F.col("_n").alias(count)] if count else []
    return rows.select(*keys, *extra, *out)


def exact_quantile_grid(df: DataFrame, keys: Sequence[str], value: str, intervals: int) -> DataFrame:
    """Quantiles at i / intervals for i = 0 … intervals in long form (keys, i, q).

    Each distinct value lists the landmarks whose lower neighbour it is and knows the next value, the upper neighbour: every
    landmark is made once and whole, without a shuffle or a join of landmarks.
    """
    return grid_of_ranks(quantile_positions(df, keys, value), keys, value, intervals)


def grid_of_ranks(ranked: DataFrame, keys: Sequence[str], value: str, intervals: int) -> DataFrame:
    """``exact_quantile_grid`` from the tie table of ``quantile_positions``."""
    rows = ranked.withColumns({"_end": F.col("n_before") + F.col("n"), "_last": F.col("n_total") - 1})
    # floor(last · i / K) = low lies in [start, end) from i = ceil(start · K / last) to ceil(end · K / last) - 1; whole numbers only.
    up_to = lambda c: F.expr(f"({c} * {intervals}L + _last - 1) div _last")
    single = F.col("_last") == 0
    first = F.when(single, F.lit(0)).otherwise(up_to("n_before"))
    final = F.when(single, F.lit(intervals)).otherwise(F.least(up_to("_end") - 1, F.lit(intervals)))
    rows = rows.withColumns({"_i0": first.cast("int"), "_i1": final.cast("int")}).where("_i0 <= _i1")
    rows = rows.withColumn("i", F.explode(F.sequence("_i0", "_i1")))
    places = F.col("_last") * F.col("i").cast("long")
    pos = places / F.lit(intervals)
    low = F.expr(f"_last * CAST(i AS BIGINT) div {intervals}L")
    high = F.least(low + 1, F.col("_last"))
    lo = F.col(value).cast("double")
    hi = F.when(high < F.col("_end"), lo).otherwise(F.col(f"{value}_next").cast("double"))
    return rows.select(*keys, "i", (lo + (hi - lo) * (pos - F.floor(pos))).alias("q"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
