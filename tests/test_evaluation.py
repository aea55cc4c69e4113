"""Threshold sweeps, adaptive thresholds and ranking metrics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import adaptive, confusion, ranking, sweep

TINY = float(np.finfo(np.float32).smallest_subnormal)
TOP = float(np.finfo(np.float32).max)
EDGE = [float(np.nextafter(np.float32(0.1), np.float32(d))) for d in (-1, 1)]
SCORES = [float(np.float32(0.1)), *EDGE, -0.0, 0.0, TINY, -TINY, float("nan"), float("inf"), float("-inf"), TOP, -TOP, 0.35, 0.7]
THRESHOLDS = [0.1, 0.0, -0.0, 0.1, TINY, -TINY, 0.5, -0.5]


def elements(spark, rows):
    return spark.createDataFrame(rows, "subject string, score float, label boolean")


def edge_rows():
    return [(s, x, (i + j) % 3 == 0) for j, s in enumerate("ab") for i, x in enumerate(SCORES)]


def test_bucket_sweep_equals_loop_sweep(spark):
    df = elements(spark, edge_rows())
    a, b = sweep.sweep_counts(df, THRESHOLDS), sweep.sweep_counts_loop(df, THRESHOLDS)
    b = b.select(a.columns)
    assert a.count() == 2 * len(THRESHOLDS)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sweep_equals_numpy(spark):
    got = {(r.subject, r.ord): (r.tp, r.fp, r.fn, r.tn) for r in sweep.sweep_counts(elements(spark, edge_rows()), THRESHOLDS).collect()}
    for subject in "ab":
        rows = [r for r in edge_rows() if r[0] == subject]
        s = np.nan_to_num(np.array([r[1] for r in rows], dtype=np.float32), nan=0, posinf=0, neginf=0)
        y = np.array([r[2] for r in rows])
        for i, t in enumerate(THRESHOLDS):
            p = s > np.float32(t)
            assert got[(subject, i)] == ((p & y).sum(), (p & ~y).sum(), (~p & y).sum(), (~p & ~y).sum())


def test_sweep_rejects_bad_thresholds(spark):
    df = elements(spark, edge_rows())
    for bad in ([], [float("nan")], [1e39]):
        with pytest.raises(ValueError):
            sweep.sweep_counts(df, bad)


def test_threshold_list_is_half_open_and_rounded():
    assert sweep.threshold_list(0.0, 0.3, 0.1) == [0.0, 0.1, 0.2]
    assert sweep.threshold_list(0.0, 0.01, 0.004) == [0.0, 0.004, 0.008]


def reference_threshold(values, method):
    v = np.asarray(values, dtype=np.float64)
    counts, edges = np.histogram(v, bins=256)
    centres = (edges[:-1] + edges[1:]) / 2
    w0, w1 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    if method == "otsu":
        m0 = np.cumsum(counts * centres) / np.maximum(w0, 1)
        m1 = (np.cumsum((counts * centres)[::-1]) / np.maximum(np.cumsum(counts[::-1]), 1))[::-1]
        score = w0[:-1] * w1[1:] * (m0[:-1] - m1[1:]) ** 2
    else:
        p = counts / counts.sum()
        p0, q0, q1 = np.cumsum(p), np.cumsum(p**2), np.cumsum((p**2)[::-1])[::-1]
        score = np.log((q0[:-1] * q1[1:]) ** -1 * (p0[:-1] * (1 - p0[:-1])) ** 2)
    return centres[int(np.argmax(score))]


@pytest.mark.parametrize("method", ["otsu", "yen"])
def test_adaptive_threshold_matches_the_published_criterion(spark, method):
    rng = np.random.default_rng(5)
    data = {"a": np.concatenate([rng.normal(0.2, 0.05, 400), rng.normal(0.7, 0.1, 90)]), "b": rng.random(300)}
    rows = [(k, float(np.float32(x)), False) for k, v in data.items() for x in v]
    got = {r.subject: r.thr for r in adaptive.adaptive_thresholds(elements(spark, rows), method).collect()}
    for k in data:
        want = reference_threshold([r[1] for r in rows if r[0] == k], method)
        assert got[k] == pytest.approx(want, rel=1e-5)


def test_constant_subject_keeps_its_constant_and_an_empty_mask(spark):
    df = elements(spark, [("c", 0.25, True)] * 5)
    thr = adaptive.adaptive_thresholds(df, "yen")
    assert thr.collect()[0].thr == pytest.approx(0.25)
    assert adaptive.adaptive_counts(df, thr).collect()[0].tp == 0
    with pytest.raises(ValueError):
        adaptive.adaptive_thresholds(df, "triangle")


def brute(labels, scores):
    y, s = np.asarray(labels), np.asarray(scores)
    p, n = s[y == 1], s[y == 0]
    auc = ((p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean()) if len(p) and len(n) else None
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        tie = s == t
        ap += y[tie].sum() * y[s >= t].sum() / (s >= t).sum()
    return auc, (ap / y.sum() if y.sum() else None)


def test_ranking_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.integers(0, 12)) / 10, bool(rng.random() < 0.3)) for k in "abc" for _ in range(150)]
    rows += [("none", 0.5, False)] * 4 + [("all", 0.5, True)] * 4
    got = {r.subject: r for r in ranking.ranking(elements(spark, rows), ["subject"]).collect()}
    for k in ("a", "b", "c", "none", "all"):
        mine = [r for r in rows if r[0] == k]
        auc, ap = brute([int(r[2]) for r in mine], [float(np.float32(r[1])) for r in mine])
        assert got[k].auc == (None if auc is None else pytest.approx(auc))
        assert got[k].ap == (None if ap is None else pytest.approx(ap))


def test_average_precision_handles_empty_and_non_finite(spark):
    rows = [("a", float("nan"), True), ("a", 0.2, False), ("b", 0.1, False)]
    got = {r.subject: r.ap for r in ranking.average_precision(elements(spark, rows), ["subject"]).collect()}
    assert got["b"] == 0.0 and got["a"] == pytest.approx(0.5)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "participant string, pair_id string, label int, probability double")


def test_binary_metrics_golden(spark):
    rows = [("p", "x", y, s) for y, s in zip([0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])]
    r = ranking.binary_metrics(predictions(spark, rows), [], score="probability").collect()[0]
    assert (r.roc_auc, r.average_precision, r.accuracy) == (1.0, 1.0, 1.0)
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 0, 2)


@pytest.mark.parametrize("label,score", [(0, -0.1), (1, 1.1), (2, 0.5)])
def test_binary_metrics_reject_bad_input(spark, label, score):
    with pytest.raises(Exception):
        ranking.binary_metrics(predictions(spark, [("p", "x", label, score), ("q", "x", 1, 0.5)]), [], score="probability").collect()


def test_subject_aggregation_golden(spark):
    rows = [("n0", "a", 0, 0.1), ("n0", "a", 0, 0.3), ("p1", "a", 1, 0.7), ("p1", "a", 1, 0.9), ("p1", "a", 1, 0.8)]
    for method, want in (("mean", {"n0": 0.2, "p1": 0.8}), ("median", {"n0": 0.2, "p1": 0.8}), ("max", {"n0": 0.3, "p1": 0.9})):
        got = ranking.aggregate_subjects(predictions(spark, rows), method=method).collect()
        assert {r.participant: r.score for r in got} == pytest.approx(want)
        assert {r.participant: r.slice_count for r in got} == {"n0": 2, "p1": 3}


def test_subject_aggregation_fails_on_conflicts(spark):
    for bad in ([("n", "a", 0, 0.1), ("n", "a", 1, 0.2)], [("n", "a", 0, 0.1), ("n", "b", 0, 0.2)], [("n", "a", 0, 0.1), ("n", None, 0, 0.2)]):
        with pytest.raises(Exception):
            ranking.aggregate_subjects(predictions(spark, bad)).collect()


def test_macro_dice_and_pooled_rates(spark):
    df = spark.createDataFrame([("a", 2, 0, 1, 1), ("b", 0, 5, 0, 0)], "subject string, tp long, tn long, fp long, fn long")
    r = confusion.macro_micro(df, []).collect()[0]
    assert r.dice == pytest.approx((2 * 2 / 6 + 0) / 2)
    assert r.precision == pytest.approx(2 / 3)
    pooled = spark.createDataFrame([("m", 768738, 74044, 1142400)], "model string, tp long, fp long, fn long")
    out = confusion.model_summary(pooled, "model").collect()[0]
    assert round(out.pooled_precision, 4) == 0.9121 and round(out.pooled_recall, 4) == 0.4022


def test_geometric_pool_with_zero_is_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("b", 1.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r.o for r in ranking.pool(df, ["k"], "v", "gmean", "o").collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        ranking.pool(df, ["k"], "v", "mode", "o")


def test_timesteps_are_bin_centres():
    assert ranking.selected_timesteps(0, 10, 5) == [1, 3, 5, 7, 9]
    with pytest.raises(ValueError):
        ranking.selected_timesteps(0, 3, 4)


def test_sampled_ap_of_small_input_is_exact_and_of_large_input_is_close(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(np.float32(rng.random() * 0.6 + 0.4 * (i % 4 == 0))), i % 4 == 0) for i in range(3000)]
    df = elements(spark, rows)
    whole = ranking.average_precision(df).collect()[0].ap
    assert ranking.sampled_average_precision(df, 5000, 73, exact_when_small=True).collect()[0].ap == pytest.approx(whole)
    every = ranking.sampled_average_precision(df, 5000, 73).collect()[0]
    assert every.n == 5000 and math.isclose(every.ap, whole, abs_tol=0.05)
    drawn = ranking.sampled_average_precision(df, 2000, 73).collect()[0]
    assert drawn.n == 2000 and math.isclose(drawn.ap, whole, abs_tol=0.05)


def test_hot_subject_gives_the_same_result(spark):
    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("subject"),
        (F.when(F.col("id") % 5 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)).cast("float").alias("score"),
        (F.pmod(F.hash("id"), F.lit(7)) == 0).alias("label"),
    )
    hot = base.where("subject = 'hot'").toPandas()
    auc, ap = brute(hot.label.astype(int), hot.score)
    got = ranking.ranking(base, ["subject"]).where("subject = 'hot'").collect()[0]
    assert got.auc == pytest.approx(auc) and got.ap == pytest.approx(ap)


def test_sweep_neither_sorts_nor_holds_rows_of_thresholds(spark):
    df = spark.createDataFrame([(k, i / 10, i % 3 == 0) for k in "ab" for i in range(11)], "subject string, score float, label boolean")
    thresholds = [0.05, 0.5, 0.5, 0.95, 2.0]
    swept = sweep.sweep_counts(df, thresholds)
    assert "Window" not in swept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, swept.collect())) == sorted(map(tuple, sweep.sweep_counts_loop(df, thresholds).collect()))
