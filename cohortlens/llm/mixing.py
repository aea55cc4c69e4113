"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. The balanced rates stay as close to that as they can (relative entropy, each
document counted by its words) while the words of each margin level meet its target. The dual of that convex problem
has one variable per level, and the rates are exponential in the sum of a document's variables. Newton's steps solve
the dual. With several margins a step needs sums over the documents, gathered by Spark per combination of levels, and one
small linear system. With one margin the levels do not meet: each takes its own steps in its own row, whatever their number.
Rates become copies by a cut through the documents of each cell in hashed order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import free_name, hash62, row_key, running_total, staged

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Levels of several margins together: the linear system of a Newton step is that large, whatever the number of documents.
MAX_LEVELS = 4000
#: Up to so many sources, their sums are broadcast to the documents; more are joined as the planner chooses.
FEW = 4000
ROUNDS = 60
TOLERANCE = 1e-11
#: Passes that fill what the cut before has left open with documents that still fit.
FILLS = 3


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of (source, size) rows, sources by code point with null last.

    The weights repeat over the ordered sources and share ``share`` times all words. A target stops at ``cap`` times the
    words of its source and the excess goes to the others by weight: a water level, found from running sums over the
    sources ordered by the level at which each of them is full. An empty source has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = totals.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    stopped = full.withColumn("stopped", F.col("ratio") * open_weight <= rest)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))).over(every), F.lit(0.0))
    level = left / F.sum(F.when(~F.col("stopped"), F.col("w"))).over(every)
    return stopped.withColumn("target", F.when(F.col("stopped"), F.col("most")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def balance(cells: DataFrame, margins: Sequence[str], targets: dict[tuple[str, object], float]) -> dict[tuple[str, object], float]:
    """Dual variables by (margin, level), so that the words of each level with a target meet it.

    ``cells`` has one row per combination of levels and its ``size``. Each step sums gradient and Hessian over the cells
    in Spark and moves along Newton's direction, halved until the dual falls. A level without words, or with target 0,
    has no finite variable: it is left out here and its documents are not taken.
    """
    names = [k for k, t in targets.items() if t > 0]
    if len(names) > MAX_LEVELS:
        raise ValueError(f"{len(names)} levels: the linear system is meant for at most {MAX_LEVELS}")
    if not names:
        return {}
    place = {k: i for i, k in enumerate(names)}
    goal, dual = np.array([targets[k] for k in names]), np.zeros(len(names))
    spark = cells.sparkSession
    levels = spark.createDataFrame([(m, None if v is None else str(v), i) for (m, v), i in place.items()], "margin string, level string, at int")
    held = cells
    for number, margin in enumerate(margins):
        part = levels.where(F.col("margin") == margin).select(F.col("level").alias("_l"), F.col("at").alias(f"_at{number}"))
        held = held.join(F.broadcast(part), F.col(margin).cast("string").eqNullSafe(F.col("_l")), "left").drop("_l")
    used = F.filter(F.array(*[F.col(f"_at{n}") for n in range(len(margins))]), lambda x: x.isNotNull())
    held = staged(held.select("size", used.alias("at")).groupBy("at").agg(F.sum("size").alias("size")).where(F.size("at") > 0))

    def sums(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        variables = F.array(*[F.lit(float(x)) for x in point])
        rate = F.exp(F.aggregate("at", F.lit(0.0), lambda total, i: total + F.get(variables, i)))
        words = held.select("at", (F.col("size") * rate).alias("words"))
        pairs = words.select(F.explode("at").alias("i"), "at", "words").select("i", F.explode("at").alias("j"), "words").groupBy("i", "j").agg(F.sum("words").alias("s")).collect()
        second = np.zeros((len(names), len(names)))
        for r in pairs:
            second[r.i, r.j] = r.s
        total = words.agg(F.coalesce(F.sum("words"), F.lit(0.0))).first()[0]
        return total - float(goal @ point), np.diag(second) - goal, second

    value, gradient, second = sums(dual)
    for _ in range(ROUNDS):
        if np.abs(gradient).max() <= TOLERANCE * goal.max():
            break
        step = np.linalg.lstsq(second, gradient, rcond=None)[0]
        scale = 1.0
        while True:
            # Far below its target a level's sum grows exponentially: a step of more than 2 is cut.
            trial = dual - scale * step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
            new_value, new_gradient, new_second = sums(trial)
            if new_value <= value + 1e-12 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        dual, value, gradient, second = trial, new_value, new_gradient, new_second
    return {k: float(x) for k, x in zip(names, dual)}


def balance_one(size: Column | str, target: Column | str) -> Column:
    """The dual variable of a level of a single margin, null for a level without words or with target 0.

    The Hessian of one margin is diagonal, so every level takes Newton's steps for itself. A step of more than 2 is cut.
    """
    size, target = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (size, target))
    step = lambda x: (size * F.exp(x) - target) / (size * F.exp(x))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(0.0), lambda x, _: x - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step(x))))
    return F.when((size > 0) & (target > 0), x)


def _rounded(rows: DataFrame, count: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``copies`` of each row of (cell, size, rate, h): whole part of the rate, plus one where the cut takes the row.

    The rows of a cell stand in hashed order. The cut takes the longest prefix whose words do not exceed the words that
    the fractions add up to; what stays open is filled by later rows that still fit, and at last by the smallest row
    left if that comes nearer to the target. ``small`` marks a table with one row per cell for a join.
    """
    keyed = rows.withColumn("copies", F.floor("rate").cast("int")).withColumn("extra", F.col("rate") - F.floor("rate"))
    budgets = keyed.groupBy("cell").agg(F.sum(F.col("extra") * F.col("size")).alias("budget"))
    for number in range(FILLS):
        # Words of one cell that are open, and the rows that could fill them.
        fits = (F.col("extra") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("budget") + 1e-6)
        joined = keyed.join(small(budgets), "cell").withColumn("fits", fits)
        ordered = running_total(joined, ["cell"], "h", F.when(F.col("fits"), F.col("size")).otherwise(0), count)
        takes = F.col("fits") & (F.col("before") + F.col("size") <= F.col("budget") + 1e-6)
        keyed = staged(ordered.withColumn("takes", takes).select("doc_id", "source", "size", "cell", "h", "rate", (F.col("copies") + F.col("takes").cast("int")).alias("copies"), F.when(F.col("takes"), 0.0).otherwise(F.col("extra")).alias("extra"), F.when(F.col("takes"), F.col("size")).otherwise(0).alias("gone"), *[c for c in rows.columns if c.startswith("_")]))
        budgets = budgets.join(small(keyed.groupBy("cell").agg(F.sum("gone").alias("gone"))), "cell").select("cell", (F.col("budget") - F.col("gone")).alias("budget"))
        # Another order each time, so that the same large row does not block the cut again.
        keyed = keyed.drop("gone").withColumn("h", hash62("h", F.lit(number)))
    least = keyed.where("extra > 0 and size > 0").groupBy("cell").agg(F.min(F.struct("size", "h", "_row")).alias("least"))
    over = budgets.join(least, "cell").where("least.size < 2 * budget").select("cell", F.col("least._row").alias("_last"))
    added = (F.col("_row") == F.col("_last")).cast("int")
    return keyed.join(small(over), "cell", "left").withColumn("copies", F.col("copies") + F.coalesce(added, F.lit(0))).drop("_last")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) and ``source``, one row per row of ``docs``.

    A null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Sources, of any number, are
    balanced as one margin; a target at the cap takes every document ``cap`` times. Repeated rows are cut like any others; as their
    hashes tie, it does not matter which of them is taken. Equal input gives equal output. Other columns are ignored.
    """
    return _mixed(docs, weights, share, cap).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Rows (_row, _k1, _k2, doc_id, source, size, cell, rate, copies, source_size, target); the keys are those of the row of ``docs``."""
    one, two = row_key(docs)
    sizes = staged(docs.select(F.monotonically_increasing_id().alias("_row"), one.alias("_k1"), two.alias("_k2"), "doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", "text").alias("_t")))
    targets = staged(source_targets(sizes, weights, share, cap))
    count = sizes.count()
    small = F.broadcast if targets.count() <= FEW else lambda sums: sums
    rate = F.exp(balance_one("source_size", "target"))
    # One row per source.
    stats = staged(targets.select(F.col("source").alias("_s"), "source_size", "target", F.round(F.least(F.coalesce(rate, F.lit(0.0)), F.lit(float(cap))), 9).alias("rate"), F.row_number().over(Window.orderBy("source")).alias("cell")))
    rows = sizes.join(small(stats), F.col("source").eqNullSafe(F.col("_s"))).withColumn("h", hash62("doc_id", "_t")).drop("_s")
    return _rounded(rows.drop("source_size", "target"), count, small).join(small(stats.select("cell", "source_size", "target")), "cell")


def repeat_to_targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all columns.

    Null and empty texts have no words and go; a null source is a source of its own; very long texts are rows like others.
    Of exact repeats the copies are counted together, so it shows only in their number which of them was taken. An empty
    table gives no rows. Only numbers and hashes are staged, and the texts shuffled once, to meet their copies.
    """
    totals = _mixed(docs, weights, share, cap).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c")).where("c > 0")
    a, b, times, whole = (free_name(docs, x) for x in ("_k1", "_k2", "_times", "_whole"))
    wanted = staged(totals.select(F.col("_k1").alias(a), F.col("_k2").alias(b), F.floor(F.col("c") / F.col("n")).cast("int").alias(times), (F.col("c") % F.col("n")).cast("int").alias(whole)))
    one, two = row_key(docs)
    every = docs.withColumns({a: one, b: two})

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)

    each = repeated(every.join(wanted.where(F.col(times) > 0).drop(whole), [a, b]))
    # Repeats whose copies do not come out even: the rest goes to one row for all of them.
    rest = wanted.where(F.col(whole) > 0).select(a, b, F.col(whole).alias(times))
    if rest.isEmpty():
        return each
    first = every.join(rest.select(a, b), [a, b], "left_semi").groupBy(a, b).agg(F.first(F.struct(*docs.columns)).alias(whole)).join(rest, [a, b])
    return each.unionByName(repeated(first.select(f"{whole}.*", times)))
