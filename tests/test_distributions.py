"""Alignment, foreground statistics, depth samples and nested configurations against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import audits, configs, normalize, splits, summaries


def frame(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")


def test_alignment_equals_numpy(spark):
    rng = np.random.default_rng(8)
    source = {"a": np.round(rng.normal(size=300), 1), "tied": [1.0] * 40 + [2.0] * 3, "one": [3.0]}
    target = {"a": rng.normal(2, 3, 170), "tied": rng.normal(size=50), "one": [7.0, 9.0]}
    methods = ["median", "iqr", "median_iqr", "quantile"]
    got = normalize.align(frame(spark, source), frame(spark, target), ["k"], "v", methods).collect()
    grid = np.linspace(0, 1, 101)
    for k, values in source.items():
        s, g = (np.quantile(x[k], [0.25, 0.5, 0.75]) for x in (source, target))
        scale = 1.0 if s[2] - s[0] <= 1e-8 else (g[2] - g[0]) / (s[2] - s[0])
        x, place = np.unique(np.round(np.quantile(values, grid), 12), return_inverse=True)
        y = np.bincount(place, weights=np.quantile(target[k], grid)) / np.bincount(place)
        want = {v: (v + g[1] - s[1], (v - s[1]) * scale + s[1], (v - s[1]) * scale + g[1], np.interp(v, x, y)) for v in values}
        rows = [r for r in got if r.k == k]
        assert len(rows) == len(values)
        for r in rows:
            assert [r[m] for m in methods] == pytest.approx(want[r.v], abs=1e-9)


def test_foreground_and_ratio(spark):
    rng = np.random.default_rng(9)
    values = {"a": np.maximum(0, rng.normal(0.5, 1, 200)), "dark": [0.0, 0.0], "b": [0.01, 2.0]}
    got = {r.k: r for r in summaries.foreground_statistics(frame(spark, values), ["k"], "v").collect()}
    for k, v in values.items():
        v = np.array(v)
        assert [got[k].positive, got[k].above_002, got[k].above_one] == pytest.approx([(v > x).mean() for x in (0, 0.02, 1)])
        if (v > 0).any():
            want = [v[v > 0].mean(), *np.quantile(v[v > 0], [0.1, 0.5, 0.9, 0.99])]
            assert [got[k][c] for c in ("positive_mean", "p10", "p50", "p90", "p99")] == pytest.approx(want)
    assert got["dark"].p99 is None and got["dark"].positive_mean is None
    ratio = {r.k: r.x for r in summaries.quantile_ratio(frame(spark, values), ["k"], "v", F.col("v") > 1, 0.5, "x").collect()}
    assert ratio["dark"] is None and ratio["b"] == pytest.approx(1.005 / 2.0)


def test_depths(spark):
    rows = spark.createDataFrame([("a", z, f"{z}-{i}") for z in (0, 3, 50, 99, 100) for i in range(z % 7 + 1)], "k string, z int, id string")
    got = summaries.depth_histogram(rows, ["k"], "z").first()
    want = [0] * 155
    for z in (0, 3, 50, 99, 100):
        want[z] = z % 7 + 1
    assert list(got.histogram) == want and got.n == sum(want) and got.inner_share == pytest.approx((want[50] + want[99]) / sum(want))
    with pytest.raises(Exception):
        summaries.depth_histogram(rows.withColumn("z", F.lit(155)), ["k"], "z").collect()
    sample = summaries.level_sample(rows, ["k"], "z", (3, 50, 60), 2, "id", 1).collect()
    assert sorted(r.z for r in sample) == [3, 3, 50, 50] and len({r.id for r in sample}) == 4


def test_quantile_error(spark):
    values = {"a": [1.0, 2.0, 5.0], "b": [0.0, 4.0]}
    target = spark.createDataFrame([(i, float(i)) for i in range(5)], "i int, q double")
    got = {r.k: r.e for r in summaries.quantile_error(frame(spark, values), ["k"], "v", target, 4, "e").collect()}
    assert got == pytest.approx({k: np.abs(np.quantile(v, np.arange(5) / 4) - np.arange(5)).mean() for k, v in values.items()})


def test_nested_configurations(spark):
    def flat(value, path=()):
        if not isinstance(value, dict):
            return {".".join(path) if path else None: value}
        return {k: v for name, x in value.items() for k, v in flat(x, (*path, name)).items()}

    a = {"1": {"x": 1, "m": {"n": {"o": [1, {"p": 2}], "e": {}}, "s": "a } { \" b"}, "nil": None}, "2": {"x": 1}, "3": [1], "4": {}}
    b = {"1": {"x": 1.5, "m": {"n": {"o": [1, {"p": 2}]}, "s": "a"}}, "2": {"x": 1}, "3": [2], "5": {"y": {"z": True}}}
    docs = [spark.createDataFrame([*((k, json.dumps(v)) for k, v in x.items()), ("6", None)], "k string, doc string") for x in (a, b)]
    paths = {(r.k, r.field): json.loads(r.value) for r in configs.config_paths(docs[0], ["k"], "doc").collect()}
    assert paths == {(k, f): v for k, x in a.items() for f, v in flat(x).items()}
    got = {(r.k, r.field): (r.a and json.loads(r.a), r.b and json.loads(r.b)) for r in configs.config_difference(*docs, ["k"], "doc").collect()}
    assert got == {("1", "x"): (1, 1.5), ("1", "m.s"): ("a } { \" b", "a"), ("1", "nil"): (None, None), ("3", None): ([1], [2]), ("5", "y.z"): (None, True)}
    assert configs.config_paths(docs[0].where("k = '6'"), ["k"], "doc").count() == 0


def test_timing_overview(spark):
    rows = [("r", "a", 2.0, False), ("r", "a", 3.0, False), ("r", "b", 1.0, True), ("r", "c", 4.0, False), ("r", None, 0.5, None)]
    timings = spark.createDataFrame(rows, "run string, subject string, s double, hit boolean")
    runs = spark.createDataFrame([("r", 12.0), ("empty", 1.0)], "run string, wall double")
    got = {r.run: r for r in summaries.timing_overview(timings, runs, ["run"], "subject", "s", "hit", "wall").collect()}
    r, e = got["r"], got["empty"]
    assert (r.inferred, r.cache_hits, r.stage_seconds, r.shared_seconds, r.overhead_seconds) == (2, 1, 10.5, 0.5, 1.5)
    assert (r.subject_mean, r.subject_median, r.subject_p95) == (pytest.approx(10 / 3), 4.0, 5.0)
    assert (e.inferred, e.cache_hits, e.overhead_seconds, e.subject_p95) == (0, 0, 1.0, None)


def test_tiny_set(spark):
    rows = spark.createDataFrame([(p, p % 2, z) for p in range(8) for z in range(p + 1)], "participant int, label int, z int")
    got = splits.tiny_set(rows, "participant", "label", 2, 6, 1, ["z"]).collect()
    people = {r.participant: r.label for r in got}
    assert len(got) <= 6 and sorted(people.values()) == [0, 0, 1, 1]
    assert all(sorted(r.z for r in got if r.participant == p) == list(range(sum(r.participant == p for r in got))) for p in people)
    for per_label, cap in ((2, 3), (5, 100)):
        with pytest.raises(ValueError):
            splits.tiny_set(rows, "participant", "label", per_label, cap, 1, ["z"])


def test_summaries_of_manifests(spark):
    cols = "pair_id string, split string, label int, participant string, z_bin int"
    rows = spark.createDataFrame([("p", "train", 0, "a", 1), ("p", "train", 1, "b", 1), ("p", "train", 0, "a", 3), ("p", "train", 1, "b", 3), ("q", "val", 0, "c", 2), ("q", "test", 1, "d", 2)], cols)
    got = {r.pair_id: r for r in audits.pair_summaries(rows).collect()}
    assert (got["p"].split, got["p"].records, got["p"].slices_per_domain, got["p"].z_histogram, got["p"].participants) == ("train", 4, 2, {1: 1, 3: 1}, ["a", "b"])
    assert got["q"].split is None and got["q"].participants == ["c", "d"]
    manifest = spark.createDataFrame([("s", "a", "1", "train"), ("s", "a", "2", "train"), ("s", "b", "1", None), ("u", None, None, "val")], "site string, subject string, session string, split string")
    got = {r.site: r for r in audits.manifest_provenance(manifest, ["site"], "split", "subject", "session").collect()}
    assert (got["s"].rows, got["s"].subjects, got["s"].sessions, got["s"].split_counts) == (3, 2, 3, {"train": 2, "": 1})
    assert (got["u"].rows, got["u"].subjects, got["u"].sessions, got["u"].columns) == (1, 0, 0, ["site", "subject", "session", "split"])


def test_cosine_quantiles(spark, monkeypatch):
    monkeypatch.setattr(summaries, "COSINE_BLOCK", 7)
    rng = np.random.default_rng(10)
    data = {"a": rng.normal(size=(40, 3)), "tied": np.tile([1.0, 2.0, 0.0], (15, 1)), "zero": np.zeros((3, 3)), "two": rng.normal(size=(2, 3)), "one": np.ones((1, 3))}
    rows = [(k, f"{k}{i}", [float(v) for v in x]) for k, m in data.items() for i, x in enumerate(m)] + [("a", "none", None)]
    levels = {"lo": 0.0, "q": 0.3, "half": 0.5, "hi": 1.0}
    got = {r.k: r for r in summaries.pairwise_cosine_quantiles(spark.createDataFrame(rows, "k string, id string, x array<double>"), ["k"], "id", "x", levels).collect()}
    assert set(got) == set(data) - {"one"}
    for k, r in got.items():
        u = data[k] / np.maximum(np.linalg.norm(data[k], axis=1, keepdims=True), 1e-12)
        c = np.clip(u @ u.T, -1, 1)[np.triu_indices(len(u), k=1)]
        assert r.pairs == len(c) and [r[n] for n in levels] == pytest.approx(list(np.quantile(c, list(levels.values()))), abs=1e-10)
