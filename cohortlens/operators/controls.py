"""Negative-control cohorts matched inside one source, and matched control slices.

Participants are matched through their class: the set of occupied bins and the mean bin on a grid. Equal classes are
matched at once; the rest by the number of bins they share, from the top, with an index of the first bins of each class.
The pairs of participants follow from the ranks inside matched classes. No pair of participants is ever tried out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import draws
from cohortlens.operators.pairing import balance_bins, first_per_bin
from cohortlens.operators.scale import attach, staged
from cohortlens.operators.sets import union
from cohortlens.sources.writers import scratch

MEAN_GRID = 4


def profiles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, participant, bins, mean_cell): occupied bins as a sorted list and the mean bin on a quarter-bin grid."""
    per_bin = rows.groupBy(*keys, "participant", "z_bin").agg(F.count(F.lit(1)).alias("n"))
    return per_bin.groupBy(*keys, "participant").agg(
        F.array_sort(F.collect_list("z_bin")).alias("bins"),
        F.round(F.sum(F.col("z_bin") * F.col("n")) / F.sum("n") * MEAN_GRID).cast("int").alias("mean_cell"),
    )


def two_groups(people: DataFrame, keys: Sequence[str], seed) -> DataFrame:
    """Two equal random halves per key; an odd participant stays out."""
    sizes = people.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(draws.permuted(people, "participant", seed, keys, "_r"), sizes, keys)
    half = F.floor(F.col("_n") / 2)
    side = F.when(F.col("_r") < half, 0).when(F.col("_r") < 2 * half, 1)
    return ranked.withColumn("side", side).where("side IS NOT NULL").drop("_r", "_n")


def match_classes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy matching of candidate class pairs, best first: (keys, c0, c1, amount, from0, from1).

    ``pairs`` is (keys, c0, c1, s0, s1, order): the classes, their sizes and a total order of preference. In every round
    the pairs that are best for both partners are matched with the smaller remaining size. The globally best open pair is
    always among them, so each round matches something and the loop ends. ``from0`` / ``from1`` are the ranks the match
    starts at inside the two classes. Each round appends its matches to one folder of the shared directory.
    """
    keys = list(keys)
    spark = pairs.sparkSession
    pairs = staged(pairs)
    folder = scratch(spark, "matches")
    schema = T.StructType(
        [*[pairs.schema[k] for k in keys], pairs.schema["c0"], pairs.schema["c1"]]
        + [T.StructField(c, T.LongType()) for c in ("amount", "from0", "from1")]
    )

    def used(so_far: DataFrame, c: str, out: str) -> DataFrame:
        return so_far.groupBy(*keys, c).agg(F.sum("amount").alias(out))

    number = 0
    while True:
        current = pairs.withColumns({"u0": F.lit(0).cast("long"), "u1": F.lit(0).cast("long")})
        if number:
            done = spark.read.schema(schema).parquet(*[f"{folder}/round-{i}" for i in range(number)])
            current = pairs.join(used(done, "c0", "_u0"), [*keys, "c0"], "left").join(used(done, "c1", "_u1"), [*keys, "c1"], "left")
            current = current.withColumns({"u0": F.coalesce("_u0", F.lit(0)), "u1": F.coalesce("_u1", F.lit(0))})
        open_pairs = current.where((F.col("s0") > F.col("u0")) & (F.col("s1") > F.col("u1")))
        # A class has a bounded number of candidate classes, so these windows are small.
        best0 = Window.partitionBy(*keys, "c0").orderBy("order")
        best1 = Window.partitionBy(*keys, "c1").orderBy("order")
        mutual = open_pairs.select("*", F.row_number().over(best0).alias("_k0"), F.row_number().over(best1).alias("_k1")).where("_k0 = 1 AND _k1 = 1")
        amount = F.least(F.col("s0") - F.col("u0"), F.col("s1") - F.col("u1"))
        step = mutual.select(*keys, "c0", "c1", amount.alias("amount"), F.col("u0").alias("from0"), F.col("u1").alias("from1"))
        step.write.parquet(f"{folder}/round-{number}")
        number += 1
        if spark.read.schema(schema).parquet(f"{folder}/round-{number - 1}").isEmpty():
            return spark.read.schema(schema).parquet(*[f"{folder}/round-{i}" for i in range(number)])


def _tie_order() -> list:
    """Total order of equally good pairs. A hash comes first: an order along the names would make neighbours wait for each
    other in long chains, while random priorities settle in a few rounds."""
    return [F.xxhash64("c0", "c1").alias("h"), F.col("c0").alias("a"), F.col("c1").alias("b")]


def expand_matches(matched: DataFrame, members0: DataFrame, members1: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member pairs of matched classes. ``members`` are (keys, cls, rank, …) with ranks inside the class.

    The planner takes the slots of a match to be as few as the matches: they are merged where the rows lie, never sent through the driver.
    """
    slots = matched.select(*keys, "c0", "c1", "from0", "from1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("amount") - 1)).alias("_s"))
    placed = slots.withColumns({"rank0": F.col("from0") + F.col("_s"), "rank1": F.col("from1") + F.col("_s")}).drop("from0", "from1", "_s")
    left = members0.withColumnsRenamed({"cls": "c0", "rank": "rank0"})
    right = members1.withColumnsRenamed({"cls": "c1", "rank": "rank1"})
    return placed.hint("merge").join(left, [*keys, "c0", "rank0"]).join(right.hint("merge"), [*keys, "c1", "rank1"])


def match_by_overlap(classes: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Matches of classes of two sides, most common bins first: (keys, c0, c1, amount, from0, from1).

    ``classes`` is (keys, side, cls, bins, mean_cell, size) with sorted bins. The law is greedy over all pairs of classes: more
    common bins, nearer means, equal classes, then a seeded hash. It is carried out without forming all of them. Equal classes
    meet first: no pair with another class can come before, as a class shares no more bins with any than it has. What is left
    is taken by the number of common bins, from the top in steps that halve it: two classes share ``level`` bins only if they
    share one among their first ``size - level + 1``, so high levels look at few bins, and what they match is gone before the low ones.
    """
    keys = list(keys)
    zero = F.lit(0).cast("long")

    def side(n: int, minimum: int) -> DataFrame:
        here = open_classes.where((F.col("side") == n) & (F.size("bins") >= minimum))
        return here.select(*keys, F.col("cls").alias(f"c{n}"), F.col("bins").alias(f"b{n}"), F.col("mean_cell").alias(f"m{n}"), (F.col("size") - F.col("used")).alias(f"s{n}"), F.col("used").alias(f"u{n}"))

    def left_after(step: DataFrame) -> DataFrame:
        spent = step.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"c{n}").alias("cls")) for n in (0, 1)])).alias("_c"), "amount")
        spent = spent.groupBy(*keys, F.col("_c.side").alias("side"), F.col("_c.cls").alias("cls")).agg(F.sum("amount").alias("_spent"))
        met = open_classes.join(spent, [*keys, "side", "cls"], "left").withColumn("used", F.col("used") + F.coalesce("_spent", zero)).drop("_spent")
        return staged(met.where("size > used"))

    open_classes = classes.withColumn("used", zero)
    equal = side(0, 1).join(side(1, 1).withColumn("c0", F.col("c1")), [*keys, "c0"])
    found = [staged(equal.select(*keys, "c0", "c1", F.least("s0", "s1").alias("amount"), zero.alias("from0"), zero.alias("from1")))]
    open_classes = left_after(found[0])
    # One number: the bins of the geometry bound it.
    level = (open_classes.agg(F.max(F.size("bins"))).first()[0] or 0) + 1
    while level > 1:
        level //= 2
        first = [side(n, level).withColumn("_bin", F.explode(F.slice(f"b{n}", F.lit(1), F.size(f"b{n}") - (level - 1)))) for n in (0, 1)]
        common = F.array_intersect("b0", "b1")
        # A pair is taken where its smallest common bin meets, so it comes up once.
        pairs = first[0].join(first[1], [*keys, "_bin"]).where((F.size(common) >= level) & (common[0] == F.col("_bin")))
        order = F.struct((-F.size(common)).alias("n"), F.abs(F.col("m0") - F.col("m1")).alias("gap"), draws.hash_text(f"{seed}:tie", "c0", "c1").alias("h"), "c0", "c1")
        matched = match_classes(pairs.select(*keys, "c0", "c1", "s0", "s1", order.alias("order")), keys)
        for n in (0, 1):
            matched = matched.join(side(n, level).select(*keys, f"c{n}", f"u{n}"), [*keys, f"c{n}"])
        found.append(staged(matched.select(*keys, "c0", "c1", "amount", (F.col("from0") + F.col("u0")).alias("from0"), (F.col("from1") + F.col("u1")).alias("from1"))))
        open_classes = left_after(found[-1])
    return union(found)


def same_cohort_pairs(rows: DataFrame, seed: int, keys: Sequence[str] = ("split",), cap: int = 2) -> DataFrame:
    """Negative-control records: two random halves per key, matched pairs, at most ``cap`` slices per common bin.

    Labels are the halves; the original label is kept. Slices come from the bins both partners have. A participant without a
    common bin with any that is left stays out.
    """
    keys = list(keys)
    people = profiles(rows, keys)
    grouped = two_groups(people, keys, seed).withColumn("cls", F.concat_ws(":", F.array_join("bins", ","), "mean_cell"))
    ranked = staged(draws.permuted(grouped, "participant", f"{seed}:class", [*keys, "side", "cls"], "rank"))
    classes = staged(ranked.groupBy(*keys, "side", "cls").agg(F.first("bins").alias("bins"), F.first("mean_cell").alias("mean_cell"), F.count(F.lit(1)).alias("size")))
    matched = match_by_overlap(classes, keys, seed)

    def members(n: int) -> DataFrame:
        return ranked.where(F.col("side") == n).select(*keys, "cls", "rank", F.col("participant").alias(f"p{n}"))

    pairs = expand_matches(matched, members(0), members(1), keys)
    pair_id = F.concat_ws(":", F.lit("negative"), *keys, F.substring(F.sha2(F.concat_ws("|", "p0", "p1"), 256), 1, 12))
    member = staged(pairs.select(pair_id.alias("pair_id"), F.explode(F.array(
        F.struct(F.col("p0").alias("participant"), F.lit(0).alias("label")), F.struct(F.col("p1").alias("participant"), F.lit(1).alias("label")))).alias("_m")
    ).select("pair_id", "_m.participant", "_m.label"))
    limited = first_per_bin(rows.withColumnRenamed("label", "original_label"), ["participant"], "z_bin", cap, ["z", "record_id"])
    return balance_bins(limited.join(member, "participant"), "pair_id", "label", "z_bin")


def even_splits(people: DataFrame, source: str, participant: str, seed: int, fractions: Sequence[float], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(source, participant, split): even sizes per source, twice the largest-remainder shares of half its participants.

    Shares are columns of the sizes, so the number of sources is free. An odd participant stays out.
    """
    half, scale = F.floor(F.col("_n") / 2), float(sum(fractions))
    raw = F.array(*[half * F.lit(float(f)) / F.lit(scale) for f in fractions])
    base = F.transform(raw, lambda x: F.floor(x))
    rest = (half - F.aggregate(base, F.lit(0).cast("long"), lambda s, x: s + x)).cast("int")
    by_rest = F.array_sort(F.transform(F.arrays_zip(raw.alias("x"), base.alias("b")), lambda e, i: F.struct((e.b - e.x).alias("k"), i.alias("i"))))
    extra = F.transform(F.slice(by_rest, F.lit(1), rest), lambda e: e.i)
    sizes = people.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).select(source, base.alias("_base"), extra.alias("_extra"))
    sizes = sizes.select(source, F.transform("_base", lambda b, i: 2 * (b + F.array_contains("_extra", i).cast("long"))).alias("_sizes"))
    met = attach(draws.permuted(people, participant, f"{seed}:split", [source], "_r"), sizes, [source])
    upto = [sum((F.col("_sizes")[j] for j in range(1, i + 1)), F.col("_sizes")[0]) for i in range(len(splits))]
    split = F.coalesce(*[F.when(F.col("_r") < u, name) for u, name in zip(upto, splits)])
    return met.select(source, participant, split.alias("split")).where("split IS NOT NULL")


def source_stratified_pairs(rows: DataFrame, seed: int, fractions: Sequence[float] = (0.40, 0.10, 0.50)) -> DataFrame:
    """Same-cohort pairs inside each source, with fresh splits of even size per source. A participant of several sources is
    drawn in each of them. ``rows`` are evaluated once; their splits are written for the steps of the matching."""
    held = staged(rows.drop("split"))
    people = held.select("source", "participant").distinct()
    assigned = even_splits(people, "source", "participant", seed, fractions)
    return same_cohort_pairs(staged(attach(held, staged(assigned), ["source", "participant"])), seed, ["source", "split"])


Z_REACH = 2
SUPPORT_REACH = 0.03
SUPPORT_GRID = 0.005
#: Cells of depth and support that are broadcast, some 20 MB; more are merged.
CELLS_AT_ONCE = 100_000


def matched_controls(low: DataFrame, pools: DataFrame, seed: int, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """One unused control slice from every pool for each low slice: |Δz| ≤ 2, |Δsupport| ≤ 0.03, another case.

    ``low`` is (keys, key, case_id, z, support) and ``pools`` the same with ``pool``. Slices are grouped to cells of
    depth and support; cells within reach are matched nearest first and their members paired by seeded rank. A pair that
    turns out to exceed the support limit or to share its case is dissolved. Low slices without a control in every pool give
    back what they hold, and ``_complete`` matches them slice by slice, so that none is left that could still have a control
    in every pool. The result has one row per low slice and pool: (keys, key, pool, control, distance). Keys of slices are unique.
    """
    keys = [*keys, "pool"]
    low, pools = staged(low), staged(pools)
    names = [r[0] for r in pools.select("pool").distinct().collect()]
    cell = F.struct(F.col("z"), F.floor(F.col("support") / SUPPORT_GRID).cast("int").alias("cell"))
    lows = low.withColumn("pool", F.explode(F.array(*[F.lit(n) for n in names])))
    rank0 = staged(draws.permuted(lows.withColumn("cls", cell), "key", f"{seed}:low", [*keys, "cls"], "rank"))
    rank1 = staged(draws.permuted(pools.withColumn("cls", cell), "key", f"{seed}:control", [*keys, "cls"], "rank"))
    matched = match_classes(_cells_in_reach(rank0, rank1, keys), keys)
    a = rank0.select(*keys, "cls", "rank", "key", F.col("case_id").alias("_c0"), F.col("z").alias("_z0"), F.col("support").alias("_s0"))
    b = rank1.select(*keys, "cls", "rank", F.col("key").alias("control"), F.col("case_id").alias("_c1"), F.col("z").alias("_z1"), F.col("support").alias("_s1"))
    gap = F.abs(F.col("_s0") - F.col("_s1"))
    good = expand_matches(matched, a, b, keys).where((gap <= SUPPORT_REACH) & (F.col("_c0") != F.col("_c1"))).select(
        *keys, "key", "control", (F.abs(F.col("_z0") - F.col("_z1")) / Z_REACH + gap / SUPPORT_REACH).alias("distance"))
    return _complete(low, pools, staged(_whole_sets(good, keys[:-1], len(names))), names, seed, keys)


def _whole_sets(found: DataFrame, keys: Sequence[str], pools: int) -> DataFrame:
    """Matches of the low slices that have one in every pool."""
    whole = found.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == pools).drop("_n")
    return found.join(whole.hint("merge"), [*keys, "key"])


def _complete(low: DataFrame, pools: DataFrame, matched: DataFrame, names: Sequence[str], seed: int, keys: Sequence[str]) -> DataFrame:
    """Adds matches for low slices that can still have an unused control in every pool, until there is none.

    In every round a low slice proposes to one control of each pool, drawn from all it may have, and a control takes the
    proposal that comes first in an order of the low slices that is the same in all pools. So the first of them that has a
    candidate everywhere gets a set in any case, and most draws do not meet: a round settles a share of what is open, not one
    slice of each crowd. In the rounds by rank a slice looks at one unused control in each cell within reach, an equi-join; only
    when these find no more sets, all controls are looked at that lie in cells whose range of support is within reach. A
    low slice with an empty pool within reach leaves for good, as unused controls only become fewer. Slices with the cells around
    them are many rows in a small file, and so are the sets of a round: their joins are merged, the planner would broadcast them by
    the size of the file. Only cells are broadcast, and only where they are few.
    """
    keys, base = list(keys), list(keys[:-1])
    steps = int(round(SUPPORT_REACH / SUPPORT_GRID))
    place = [*keys, "_z", "_cell"]
    cell = F.floor(F.col("support") / SUPPORT_GRID).cast("int")
    unused = pools.select(*keys, F.col("key").alias("control"), F.col("case_id").alias("_case"), F.col("z").cast("int").alias("_z"), cell.alias("_cell"), F.col("support").alias("_support"))
    waiting = low.select(*base, "key", "case_id", "z", "support", cell.alias("_own"))
    gap = F.abs(F.col("support") - F.col("_support"))
    turn = F.struct(draws.hash_text(f"{seed}:turn", "key").alias("turn"), F.col("key"))
    sets, step, number, by_rank = [matched], matched, 0, True
    while True:
        unused = staged(unused.join(step.select(*keys, "control").hint("merge"), [*keys, "control"], "left_anti"))
        ranked = draws.permuted(unused, "control", f"{seed}:{number}:unused", place, "_r")
        cells = unused.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.min("_support").alias("_from"), F.max("_support").alias("_to"))
        around = waiting.join(step.select(*base, "key").distinct().hint("merge"), [*base, "key"], "left_anti").withColumn("pool", F.explode(F.array(*[F.lit(n) for n in names])))
        around = around.withColumn("_dz", F.explode(F.sequence(F.lit(-Z_REACH), F.lit(Z_REACH)))).withColumn("_ds", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
        if not number:
            # Cells only become fewer.
            side = "broadcast" if cells.count() <= CELLS_AT_ONCE else "merge"
        around = around.withColumns({"_z": (F.col("z") + F.col("_dz")).cast("int"), "_cell": F.col("_own") + F.col("_ds")}).drop("_ds", "_own")
        # A rounded limit must not rule a cell out: the exact test follows on the pairs.
        near = around.join(cells.hint(side), place).where((F.col("_from") - F.col("support") <= SUPPORT_REACH + 1e-9) & (F.col("support") - F.col("_to") <= SUPPORT_REACH + 1e-9))
        hopeful = near.groupBy(*base, "key").agg(F.countDistinct("pool").alias("_n")).where(F.col("_n") == len(names)).drop("_n")
        near = staged(near.join(hopeful.hint("merge"), [*base, "key"], "left_semi"))
        waiting = staged(near.groupBy(*base, "key").agg(*[F.first(c).alias(c) for c in ("case_id", "z", "support")]).withColumn("_own", cell))
        if by_rank:
            drawn = near.withColumn("_r", draws.hash_index(F.col("_n"), f"{seed}:{number}", "key", "_z", "_cell").cast("long"))
            met = drawn.hint("merge").join(ranked, [*place, "_r"])
        else:
            met = near.hint("merge").join(unused, place)
        edges = met.where((gap <= SUPPORT_REACH) & (F.col("case_id") != F.col("_case")))
        able = (F.abs("_dz") / Z_REACH + gap / SUPPORT_REACH).alias("distance")
        lot = F.struct(draws.hash_text(f"{seed}:{number}:lot", "key", "control").alias("lot"), F.col("control"), able)
        # One proposal for each low slice and pool, then one low slice for each control.
        asked = edges.groupBy(*keys, "key").agg(F.min(lot).alias("_e")).select(*keys, "key", "_e.control", "_e.distance")
        asked = staged(_whole_sets(asked, base, len(names)))
        taken = asked.groupBy(*keys, "control").agg(F.min(F.struct(turn.alias("turn"), F.col("distance"))).alias("_t")).select(*keys, "control", F.col("_t.turn.key").alias("key"), F.col("_t.distance").alias("distance"))
        number += 1
        if asked.isEmpty():
            if not by_rank:
                return union(sets)
            by_rank, step = False, asked
            continue
        step = staged(_whole_sets(taken, base, len(names)).select(*matched.columns))
        sets.append(step)
        by_rank = True


def _cells_in_reach(rank0: DataFrame, rank1: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate cell pairs: each cell looks at the fixed number of cells within reach, so this is an equi-join."""
    steps = int(round(SUPPORT_REACH / SUPPORT_GRID))
    sizes0 = rank0.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("s0")).withColumnRenamed("cls", "c0")
    sizes1 = rank1.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("s1")).withColumnRenamed("cls", "c1")
    near = sizes0.withColumn("_dz", F.explode(F.sequence(F.lit(-Z_REACH), F.lit(Z_REACH)))).withColumn(
        "_ds", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))
    )
    target = F.struct((F.col("c0.z") + F.col("_dz")).cast("int").alias("z"), (F.col("c0.cell") + F.col("_ds")).alias("cell"))
    pairs = near.withColumn("c1", target).hint("merge").join(sizes1, [*keys, "c1"])
    distance = F.round(F.abs(F.col("_dz")) / Z_REACH + F.abs(F.col("_ds")) * SUPPORT_GRID / SUPPORT_REACH, 9)
    order = F.struct(distance.alias("d"), *_tie_order())
    return pairs.select(*keys, "c0", "c1", "s0", "s1", order.alias("order"))
