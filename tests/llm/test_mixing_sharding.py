"""Entropy balancing and k-d sharding: targets, laws and edge cases."""

import random

import numpy as np
import pytest

from cohortlens.llm import common, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, cell string, node string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "a", "b", "c", "d") for i, t, lang, s in rows], SCHEMA)


def corpus(seed=3, n=600):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * max(1, int(r.expovariate(1 / 120)))) + f" {i}", r.choice(["en", "de", None]), "hot" if i % 3 == 0 else r.choice(["a", "b", "c", None])) for i in range(n)]
    return rows + [(n, None, "en", "a"), (n + 1, "", "en", "void"), (n + 2, "y " * 20_000, "en", "hot"), (5, "z", "en", "b"), (None, "q q", None, None)] + [(7, "same text", "en", "a")] * 40


def water_level(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
    return target


def test_targets_are_met(spark):
    rows = corpus()
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_level(sizes, (3, 1, 2), 1.5, 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.taken == r.copies * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in sizes)
    again = mixing.mix_sources(frame(spark, rows).repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    repeated = mixing.repeat_to_targets(frame(spark, rows))
    assert repeated.columns == frame(spark, rows).columns and repeated.count() == sum(r.copies for r in got)


def test_more_sources_than_a_linear_system_holds(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(1, 9), "en", f"site{i % 4500}.example") for i in range(9000)] + [(9000, "w w w", "en", None), (9001, None, "en", "empty.example")]
    docs = frame(spark, rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = water_level(sizes, (3, 1, 2), 1.5, 2), dict.fromkeys(sizes, 0)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes) and taken["empty.example"] == 0


def test_one_margin_as_columns(spark):
    levels = [(str(i), float(s), float(t)) for i, (s, t) in enumerate([(100, 150), (7, 14), (1e9, 3), (5, 5), (3, 1e4), (0, 0), (9, 0)])]
    frame_of = spark.createDataFrame(levels, "k string, size double, target double")
    dual = mixing.balance(frame_of, ["k"], {("k", k): t for k, _, t in levels[:4]})
    got = {r.k: r.x for r in frame_of.withColumn("x", mixing.balance_one("size", "target")).collect()}
    assert all(got[k] == pytest.approx(dual["k", k], abs=1e-8) for k in "013") and got["5"] is None and got["6"] is None
    assert all(s * np.exp(got[k]) == pytest.approx(t, rel=1e-12) for k, s, t in levels[:5])


def test_two_margins_meet_their_targets(spark):
    r = np.random.default_rng(1)
    cells = [(a, b, float(r.integers(100, 1000))) for a in "xyz" for b in "pq"]
    goals = {("m", "x"): 500.0, ("m", "y"): 900.0, ("m", "z"): 1600.0, ("k", "p"): 1000.0, ("k", "q"): 2000.0}
    dual = mixing.balance(spark.createDataFrame(cells, "m string, k string, size double"), ["m", "k"], goals)
    rate = {(a, b): np.exp(dual["m", a] + dual["k", b]) for a, b, _ in cells}
    for (margin, level), goal in goals.items():
        assert sum(s * rate[a, b] for a, b, s in cells if level in (a, b) and (a if margin == "m" else b) == level) == pytest.approx(goal, rel=1e-6)


def test_shards_are_near_equal(spark):
    rows = [r for r in corpus(n=900) if r[0] != 902]
    got = sharding.kd_shards(frame(spark, rows), 16).collect()
    sizes = sorted(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    assert sorted(r.size for r in got) == sizes
    totals, slots = {}, {}
    for r in got:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(totals) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(totals.values()) - min(totals.values()) <= 3 * sizes[-1]
    assert len({r.shard for r in got if r.doc_id == 7}) <= 2
    odd = sharding.kd_shards(frame(spark, rows), 5).collect()
    shares = [sum(r.size for r in odd if r.shard == s) for s in range(5)]
    assert max(shares) - min(shares) <= 3 * sizes[-1]
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.kd_shards(frame(spark, rows).repartition(5), 16).collect()}
    assert all(again[r.doc_id, r.text_crc32] == r.shard for r in got)


def test_one_text_that_fills_many_shards(spark):
    got = sharding.kd_shards(frame(spark, [(i, "same " * 50, "en", "a") for i in range(320)]), 16).collect()
    assert sorted(sum(r.shard == s for r in got) for s in range(16)) == [20] * 16


def test_empty_and_single(spark):
    assert sharding.kd_shards(frame(spark, [])).collect() == [] and mixing.mix_sources(frame(spark, [])).collect() == []
    assert [(r.size, r.shard, r.slot) for r in sharding.kd_shards(frame(spark, [(1, None, None, None)])).collect()] in [[(1, s, 0)] for s in range(16)]
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, None, None)])).collect()] == [0]


def test_running_total_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 10)
    rows = [(k, i) for k in ("a", None) for i in range(100)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k string, v int").withColumn("h", common.hash62("v"))
    got = common.running_total(df, ["k"], "h", F.col("v"), 200).collect()
    for key in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: r.h):
            assert r.before == total
            total += r.v
