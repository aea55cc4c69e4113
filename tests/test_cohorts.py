"""Splits, balancing, pairs, controls and permutations."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cohortlens.operators import audits, controls, pairing, splits
from cohortlens.operators.sets import AuditError
from cohortlens.sources import manifests


def ids(spark, n):
    return spark.createDataFrame([(f"s{i}",) for i in range(n)], "subject string")


def test_largest_remainder():
    assert splits.largest_remainder([1, 1, 1], 5) == [2, 2, 1]
    assert splits.split_sizes(3, (0.7, 0.15, 0.15)) == [1, 1, 1]
    assert sum(splits.split_sizes(101, (0.7, 0.15, 0.15))) == 101
    with pytest.raises(ValueError):
        splits.split_sizes(3, (0.5, 0.5, 0.5))


def test_participant_split_is_disjoint_and_order_free(spark):
    a = splits.participant_split(ids(spark, 20), "subject").collect()
    b = splits.participant_split(ids(spark, 20).orderBy(F.desc("subject")).repartition(5), "subject").collect()
    assert sorted(a) == sorted(b)
    assert {r.split for r in a} == {"train", "val", "test"} and len(a) == 20


def test_unknown_participant_stops_the_job(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "participant string")
    mapping = spark.createDataFrame([("a", "train")], "participant string, split string")
    with pytest.raises(Exception):
        splits.apply_split_map(rows, mapping).collect()


def test_kfold_without_shuffle(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "subject int")
    rows = splits.kfold(df, "subject", 3, shuffle=False).where("role = 'validation'").collect()
    folds = {f: sorted(r.subject for r in rows if r.fold == f) for f in range(3)}
    assert folds == {0: [0, 1], 1: [2, 3], 2: [4]}
    for bad in (1, 6):
        with pytest.raises(ValueError):
            splits.kfold(df, "subject", bad)


def test_rolling_windows_cover_in_turn(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "subject int")
    rows = splits.rolling_test_windows(df, "subject", 4, 3).where("role = 'test'").collect()
    assert all(sum(r.fold == f for r in rows) == 3 for f in range(4))
    with pytest.raises(ValueError):
        splits.rolling_test_windows(df, "subject", 2, 7)


def test_balance_by_level_golden(spark):
    df = spark.createDataFrame([(4, "a"), (4, "b"), (4, "c"), (1, "d"), (1, "e")], "z int, id string")
    out = splits.balance_by_level(df, "z", "id", 2, 1)
    assert {(r.z, r["count"]) for r in out.groupBy("z").count().collect()} == {(4, 2), (1, 2)}
    two = spark.createDataFrame([(5, "a"), (5, "b")], "z int, id string")
    rows = splits.balance_by_level(two, "z", "id", 5, 1).collect()
    assert len(rows) == 5 and sum(r.is_extra_sample for r in rows) == 1
    assert {r.duplicate_copy_id for r in rows if not r.is_extra_sample} == {0, 1}


def test_quota_and_draw(spark):
    weights = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "bucket int, weight int")
    assert [r.quota for r in splits.quotas(weights, "bucket", "weight", 5).orderBy("bucket").collect()] == [2, 2, 1]
    src = spark.createDataFrame([(0, f"r{i}") for i in range(7)], "bucket int, id string")
    quota = spark.createDataFrame([(0, 25)], "bucket int, quota int")
    copies = [r["count"] for r in splits.draw_by_quota(src, "bucket", "id", quota, 3).groupBy("id").count().collect()]
    assert sum(copies) == 25 and max(copies) - min(copies) <= 1
    four = spark.createDataFrame([(0, 4)], "bucket int, quota int")
    assert splits.draw_by_quota(src, "bucket", "id", four, 3).select("id").distinct().count() == 4


def record(participant, case, z, label):
    norm = z / 19
    return ("train", participant, case, z, norm, min(19, int(20 * norm)), label, f"{participant}:{case}:{z}")


SCHEMA = "split string, participant string, case_id string, z int, z_norm double, z_bin int, label int, record_id string"


def test_pairing_golden(spark):
    healthy = [record("h", "c1", z, 0) for z in (0, 1, 10, 11, 19)] + [record("h", "c2", z, 0) for z in (0, 1, 2, 3)]
    lesion = [record("b", "d1", z, 1) for z in (0, 2, 10, 12, 19)]
    out = pairing.build_pairs(spark.createDataFrame(healthy, SCHEMA), spark.createDataFrame(lesion, SCHEMA))
    rows = out.records.collect()
    assert out.pairs.count() == 1 and out.exclusions.isEmpty()
    assert {r.case_id for r in rows} == {"c1", "d1"}
    assert sum(r.label for r in rows) * 2 == len(rows) > 0
    assert audits.record_audit(out.records).isEmpty() and audits.pair_audit(out.records).isEmpty()


def test_pair_without_common_bin_is_excluded(spark):
    a = spark.createDataFrame([record("h", "c", 0, 0)], SCHEMA)
    b = spark.createDataFrame([record("b", "d", 19, 1)], SCHEMA)
    out = pairing.build_pairs(a, b)
    assert out.records.isEmpty() and out.exclusions.collect()[0].reason == "no_common_z_bin"


def test_audits_find_planted_faults(spark):
    good = [record("h", "c", 0, 0), record("b", "d", 0, 1)]
    df = spark.createDataFrame(good, SCHEMA).withColumn("pair_id", F.lit("p"))
    assert audits.pair_audit(df).isEmpty()
    assert {r.rule for r in audits.pair_audit(df.where("label = 0")).collect()} >= {"labels", "slice_count_mismatch"}
    assert {r.rule for r in audits.record_audit(df.unionByName(df)).collect()} == {"duplicate_record"}
    moved = df.withColumn("z_bin", F.col("z_bin") + 1)
    assert {r.rule for r in audits.record_audit(moved).collect()} == {"z_bin_mismatch"}
    both = df.unionByName(df.withColumns({"split": F.lit("val"), "record_id": F.concat("record_id", F.lit("x"))}))
    assert "participant_in_several_splits" in {r.rule for r in audits.record_audit(both).collect()}


def test_label_permutations_keep_pairs_and_participants(spark):
    rows = [(f"p{i}", f"h{i}", 0) for i in range(30)] + [(f"p{i}", f"b{i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows * 2, "pair_id string, participant string, label int").withColumn("split", F.lit("train"))
    flipped = pairing.flip_by_pair(df, 3)
    per = flipped.groupBy("pair_id").agg(F.sum("label").alias("s"), F.countDistinct("participant", "label").alias("n")).collect()
    assert all(r.s == 2 and r.n == 2 for r in per)
    assert 0 < flipped.where("flipped = 1").select("pair_id").distinct().count() < 30
    half = pairing.balanced_flip(df, 3).where("flipped = 1").select("pair_id").distinct().count()
    assert half == 15
    shuffled = pairing.shuffle_participant_labels(df, 3)
    assert shuffled.groupBy("participant").agg(F.countDistinct("label").alias("n")).where("n > 1").isEmpty()
    assert shuffled.agg(F.sum("label")).first()[0] == 60


def test_same_cohort_pairs_are_balanced_and_use_each_participant_once(spark):
    rows = []
    for i in range(41):
        for z in range(i % 5, 20 - i % 3):
            rows.append(record(f"p{i:02d}", f"c{i}", z, 0))
    out = controls.same_cohort_pairs(spark.createDataFrame(rows, SCHEMA), 7)
    assert audits.pair_audit(out.select("*")).isEmpty()
    people = out.select("pair_id", "participant").distinct()
    assert people.count() == 40 and people.select("participant").distinct().count() == 40
    assert out.where("original_label <> 0").isEmpty()


def test_matched_controls_respect_every_limit(spark):
    low = [("all", f"l{i}", f"c{i % 9}", i % 12, 0.2 + (i % 10) / 50) for i in range(40)]
    pool = [("all", f"{p}{i}", f"c{i % 11}", i % 12, 0.2 + (i % 13) / 60, p) for p in "xy" for i in range(150)]
    a = spark.createDataFrame(low, "partition string, key string, case_id string, z int, support double")
    b = spark.createDataFrame(pool, "partition string, key string, case_id string, z int, support double, pool string")
    out = controls.matched_controls(a, b, 1)
    rows = out.join(a.select("key", F.col("z").alias("z0"), F.col("support").alias("s0"), F.col("case_id").alias("c0")), "key").join(
        b.select(F.col("key").alias("control"), "pool", F.col("z").alias("z1"), F.col("support").alias("s1"), F.col("case_id").alias("c1")), ["control", "pool"]).collect()
    assert rows
    for r in rows:
        assert abs(r.z0 - r.z1) <= 2 and abs(r.s0 - r.s1) <= 0.03 + 1e-12 and r.c0 != r.c1
    assert len({(r.pool, r.control) for r in rows}) == len(rows)
    assert all(sum(r.key == k for r in rows) == 2 for k in {r.key for r in rows})


def test_subject_csv_checks(spark, tmp_path):
    good, bad, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    good.write_text("﻿subject,site\n\"s0\",x\ns1,y\n", encoding="utf-8")
    bad.write_text("subject\ns0\ns0\n")
    empty.write_text("subject\n")
    df = manifests.read_subject_csv(spark, str(good))
    assert df.columns == ["subject", "site"] and df.count() == 2
    for path in (bad, empty):
        with pytest.raises(AuditError):
            manifests.read_subject_csv(spark, str(path))


def test_corrupt_manifest_line_stops_the_job(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"split":"train","z":1}\n{broken\n')
    with pytest.raises(Exception):
        manifests.read_jsonl_manifest(spark, str(path)).collect()


def test_store_must_be_contiguous(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0]), (2, [1.0])], "slice_id long, px array<float>")
    df.write.parquet(str(tmp_path / "store"))
    with pytest.raises(AuditError):
        manifests.read_slice_store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("seed", [1, 2])
def test_no_admissible_control_is_left(spark, seed):
    """Crowded cells, few cases, scarce pools: checked against the definition, slice by slice."""
    rng = np.random.default_rng(seed)

    def slices(n, name):
        return [("p", f"{name}{i}", f"c{rng.integers(3)}", int(rng.integers(4)), float(np.round(0.5 + rng.integers(40) * 0.002, 4))) for i in range(n)]

    low, pools = slices(40, "l"), [(*x, pool) for pool, n in (("a", 25), ("b", 30)) for x in slices(n, pool)]
    cols = "partition string, key string, case_id string, z int, support double"
    got = controls.matched_controls(spark.createDataFrame(low, cols), spark.createDataFrame(pools, f"{cols}, pool string"), 5).collect()

    def fits(a, b):
        return abs(a[3] - b[3]) <= 2 and abs(a[4] - b[4]) <= 0.03 and a[2] != b[2]

    lows, others = {x[1]: x for x in low}, {(x[5], x[1]): x for x in pools}
    used = {(r.pool, r.control) for r in got}
    held = {}
    for r in got:
        assert fits(lows[r.key], others[r.pool, r.control])
        held.setdefault(r.key, []).append(r.pool)
    assert len(used) == len(got) and all(sorted(p) == ["a", "b"] for p in held.values()) and held
    for key in set(lows) - set(held):
        assert any(not any(fits(lows[key], x) for (p, k), x in others.items() if p == pool and (p, k) not in used) for pool in "ab")


def test_a_crowd_of_low_slices_settles_in_few_rounds(spark, monkeypatch):
    """Ninety low slices are in reach of the same eighty controls: a round has to settle a share of them, not one."""
    cols = "p string, key string, case_id string, z int, support double"
    low = spark.createDataFrame([("p", f"l{i}", "x", 0, 0.5001) for i in range(90)], cols)
    pools = spark.createDataFrame([("p", f"c{i}", "y", 0, 0.5001 + i * 1e-6, "a") for i in range(80)], f"{cols}, pool string")
    writes, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: writes.append(path) or write(self, path, *a, **k))
    none = spark.createDataFrame([], "p string, key string, pool string, control string, distance double")
    got = controls._complete(low, pools, none, ["a"], 5, ["p", "pool"]).collect()
    assert len(got) == len({r.control for r in got}) == len({r.key for r in got}) == 80
    assert len(writes) < 75


def test_slots_of_a_match_are_not_broadcast(spark):
    """A match is one small row and stands for as many pairs as its amount: the size of its table says nothing of theirs."""
    cell = "STRUCT<z: INT, cell: INT>"
    matched = spark.createDataFrame([("p", (0, 1), (0, 2), 5000, 0, 0)], f"p string, c0 {cell}, c1 {cell}, amount long, from0 long, from1 long")
    side = [spark.range(5000).select(F.lit("p").alias("p"), F.struct(F.lit(0).alias("z"), F.lit(n).alias("cell")).alias("cls"), F.col("id").alias("rank"), F.col("id").alias(name)) for n, name in ((1, "key"), (2, "control"))]
    out = controls.expand_matches(matched, *side, ["p"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("key = control").count() == 5000


@pytest.mark.parametrize("most", [0, 100_000])
def test_rounds_of_matching_broadcast_cells_only(spark, monkeypatch, most):
    """Slices, their proposals and their sets stay where they lie, by rank and in the last rounds that look at all controls."""
    monkeypatch.setattr(controls, "CELLS_AT_ONCE", most, raising=False)
    cols, plans, write = "p string, key string, case_id string, z int, support double", [], controls.staged
    low = spark.createDataFrame([("p", f"l{i}", "x", 0, 0.5001) for i in range(30)], cols)
    pools = spark.createDataFrame([("p", f"c{i}", "y", 0, 0.5001 + i * 1e-6, "a") for i in range(20)] + [("p", "d", "x", 0, 0.5001, "a")], f"{cols}, pool string")
    monkeypatch.setattr(controls, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    none = spark.createDataFrame([], "p string, key string, pool string, control string, distance double")
    assert controls._complete(low, pools, none, ["a"], 5, ["p", "pool"]).count() == 20
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in x for x in joins)
    assert not [x for x in joins if "Broadcast" in x and (not most or "BuildLeft" in x or any(f"{c}#" in x for c in (" key", "[key", "control", "_r")))]


def greedy_classes(side0, side1, seed):
    """All pairs of classes in one order, taken one after the other: {(c0, c1): amount}."""
    left = [{c: n for c, _, _, n in s} for s in (side0, side1)]
    order = []
    for c0, b0, m0, _ in side0:
        for c1, b1, m1, _ in side1:
            common = len(set(b0) & set(b1))
            if common:
                tie = hashlib.md5(f"{seed}:tie|{c0}|{c1}".encode()).hexdigest()
                order.append((-common, abs(m0 - m1), c0 != c1, tie, c0, c1))
    out = {}
    for *_, c0, c1 in sorted(order):
        amount = min(left[0][c0], left[1][c1])
        if amount:
            out[c0, c1] = amount
            left[0][c0] -= amount
            left[1][c1] -= amount
    return out


def test_match_by_overlap_is_greedy_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    sides = {}
    for key in ("x", "y"):
        pool = {}
        while len(pool) < 14:
            bins = sorted(int(b) for b in rng.choice(8, rng.integers(1, 6), replace=False))
            mean = int(rng.integers(0, 5))
            pool[",".join(map(str, bins)) + f":{mean}"] = (bins, mean)
        names = sorted(pool)
        sides[key] = [[(c, *pool[c], int(rng.integers(1, 9))) for c in names if rng.random() < 0.7] for _ in (0, 1)]
    sides["z"] = [[("7:1", [7], 1, 3)], [("1:1", [1], 1, 3)]]  # nothing in common
    rows = [(k, n, *c) for k, both in sides.items() for n in (0, 1) for c in both[n]]
    classes = spark.createDataFrame(rows, "split string, side int, cls string, bins array<int>, mean_cell int, size long")
    got = controls.match_by_overlap(classes, ["split"], 7).collect()
    for key, both in sides.items():
        mine = {(r.c0, r.c1): r.amount for r in got if r.split == key}
        assert mine == greedy_classes(*both, 7)
        for n in (0, 1):
            # Ranks of a class are given out once, without gaps.
            for c, _, _, size in both[n]:
                used = sorted((r[f"from{n}"], r.amount) for r in got if r.split == key and r[f"c{n}"] == c)
                assert [f for f, _ in used] == [sum(a for _, a in used[:i]) for i in range(len(used))] and sum(a for _, a in used) <= size
    assert controls.match_by_overlap(classes.where("false"), ["split"], 7).isEmpty()


def test_source_stratified_pairs(spark):
    rows = []
    for source, people in ((0, 23), (2, 10), (4, 1)):
        for i in range(people):
            for z in range(i % 4, 20 - i % 3):
                rows.append((*record(f"{source}p{i:02d}", f"c{i}", z, 0), source))
    data = spark.createDataFrame(rows, SCHEMA + ", source int")
    out = controls.source_stratified_pairs(data, 7)
    assert audits.pair_audit(out).isEmpty()
    sizes = {}
    for r in out.select("source", "split", "participant").distinct().collect():
        sizes[r.source, r.split] = sizes.get((r.source, r.split), 0) + 1
    expected = {(s, n): 2 * k for s, people in ((0, 23), (2, 10)) for n, k in zip(("train", "val", "test"), splits.largest_remainder((0.4, 0.1, 0.5), people // 2)) if k}
    assert sizes == expected
    inside = out.groupBy("pair_id").agg(F.countDistinct("source").alias("s"), F.countDistinct("split").alias("t"))
    assert inside.where("s > 1 OR t > 1").isEmpty()
    # The records were evaluated once, when they were written: what is left reads stored tables only.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan


def test_both_sides_of_a_pairing_take_their_first_case_in_one_join(spark):
    rows = spark.createDataFrame([(p, c, z, z, p % 2, "train", f"{p}:{c}:{z}") for p in range(8) for c in range(2) for z in range(2)],
                                 "participant long, case_id long, z int, z_bin int, label int, split string, record_id string")
    built = pairing.build_pairs(rows.where("label = 0"), rows.where("label = 1"))
    # A union of two such joins fails where adaptive execution cuts one side into more partitions than the other.
    lines = built.records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at, depth = next((i, len(x) - len(x.lstrip(" :+-"))) for i, x in enumerate(lines) if "Union" in x)
    below = list(itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth, lines[at + 1:]))
    assert below and not any("Join" in x for x in below)
    found = built.records.collect()
    assert len(found) == 16 and {r.case_id for r in found} == {0}
    # A participant on both sides has a first case on each.
    both = rows.where("case_id = 1 or label = 0").withColumn("participant", F.lit(1).cast("long"))
    assert {(r.label, r.case_id) for r in pairing.primary_case(both, within=["label"]).collect()} == {(0, 0), (1, 1)}
