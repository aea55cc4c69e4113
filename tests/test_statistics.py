"""Bootstrap, swap test, Holm, gates, QC and the control model."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators import audits, gates, model, pairing, ranking, resampling
from cohortlens.sources import metrics_csv

SUBJECT = "participant string, pair_id string, label int, score double"


def pairs(spark, scores):
    rows = [(f"{'nb'[j]}{i}", f"p{i}", j, s) for i, both in enumerate(scores) for j, s in enumerate(both)]
    return spark.createDataFrame(rows, SUBJECT)


def test_bootstrap_and_swap_golden(spark):
    df = pairs(spark, [(0.2, 0.8), (0.4, 0.6), (0.45, 0.55)])
    boot = resampling.bootstrap_auc(df, replicates=200).collect()[0]
    assert boot.observed_auc == 1.0 and boot.n_valid == 200 and boot.n_units == 3
    swap = resampling.swap_test(df, swaps=200).collect()[0]
    assert swap.n_pairs == 3 and swap.status == "complete" and 0 < swap.p_value <= 1


def test_malformed_pairs_stop_the_job(spark):
    three = spark.createDataFrame([("a", "p", 0, 0.1), ("b", "p", 1, 0.2), ("c", "p", 1, 0.3)], SUBJECT)
    missing = spark.createDataFrame([("a", "p", 0, 0.1), ("b", None, 1, 0.2)], SUBJECT)
    for bad in (three, missing):
        with pytest.raises(Exception):
            resampling.swap_test(bad, swaps=5).collect()


def test_bootstrap_interval_is_plausible(spark):
    rng = np.random.default_rng(2)
    df = pairs(spark, [(float(a), float(min(1, a + b))) for a, b in zip(rng.random(60) * 0.7, rng.random(60) * 0.4)])
    r = resampling.bootstrap_auc(df, replicates=100).collect()[0]
    assert r.ci_low < r.observed_auc < r.ci_high


def brute_holm(p):
    order = sorted((x, i) for i, x in enumerate(p) if x is not None)
    out, run = [None] * len(p), 0.0
    for rank, (x, i) in enumerate(order):
        run = max(run, min(1.0, (len(order) - rank) * x))
        out[i] = run
    return out


@pytest.mark.parametrize("function", [resampling.holm, resampling.holm_large])
def test_holm_equals_brute_force(spark, function):
    p = [0.01, 0.04, 0.03, None, 0.005, 0.03, 0.9]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, test int, p_value double")
    got = {r.test: r.p_holm for r in function(df, ["family"]).collect()}
    want = brute_holm(p)
    assert got[3] is None
    assert [got[i] for i in range(7) if i != 3] == pytest.approx([w for w in want if w is not None])


def test_holm_needs_a_complete_family(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.02)], "family string, p_value double")
    assert {r.family_status for r in resampling.holm_if_complete(df, ["family"], 3).collect()} == {"INCONCLUSIVE"}
    done = resampling.holm_if_complete(df, ["family"], 2).collect()
    assert sorted(r.p_holm for r in done) == pytest.approx([0.02, 0.02])


def test_gates(spark):
    tiny = spark.createDataFrame([(1, 0.995, 0.01), (2, None, 0.01)], "seed int, accuracy double, bce double")
    assert gates.tiny_gate(tiny, []).collect()[0].status == "INCONCLUSIVE"
    assert gates.tiny_gate(tiny.where("seed = 1"), []).collect()[0].status == "PASS"
    cols = "seed int, auc double, ci_low double, ci_high double, p_value double, deviation double, swap_status string"
    ok = spark.createDataFrame([(1, 0.5, 0.41, 0.59, 0.8, 0.0, "complete"), (2, 0.52, 0.42, 0.58, 0.7, 0.02, "complete")], cols)
    r = gates.negative_gate(ok, []).collect()[0]
    assert (r.status, r.closeness_status) == ("PASS", "PASS")
    assert gates.negative_gate(ok.withColumn("p_value", F.lit(0.001)), []).collect()[0].status == "FAIL"
    assert gates.negative_gate(ok.withColumn("ci_high", F.lit(0.9)), []).collect()[0].status == "INCONCLUSIVE"


def test_missing_control_is_inconclusive(spark):
    row = spark.createDataFrame([(1.0, 0.9, 1.0, True, None)], "auc double, ci_low double, ci_high double, a boolean, b boolean")
    r = gates.apply_gates(row, ["a", "b"]).collect()[0]
    assert r.control_gate_status == "INCONCLUSIVE" and r.evidence_status == "INCONCLUSIVE"
    r = gates.apply_gates(row.withColumn("b", F.lit(True)), ["a", "b"]).collect()[0]
    assert r.control_gate_status == "PASS" and r.evidence_status == "COMPLETE" and r.low_separability_status == "FAIL"


BASE = dict(image_finite=True, mask_finite=True, geometry_valid=True, shape_valid=True, brain_volume_L=1.4, det=1.0, sv_min=0.9, sv_max=1.1, mask_dice=0.9,
            T1_MNI_MI_improvement=0.2, FLAIR_T1_MI_improvement=0.2, T2_T1_MI_improvement=0.2, guard_retention=0.99)


def test_qc_golden(spark):
    rows = [BASE, {**BASE, "mask_dice": 0.699}, {**BASE, "guard_retention": 0.9}, {**BASE, "det": float("nan")}]
    out = audits.qc_status(spark.createDataFrame([{"i": i, **r} for i, r in enumerate(rows)])).orderBy("i").collect()
    assert [r.status for r in out] == ["PASS", "FAIL", "REVIEW", "FAIL"]
    assert out[0].flags == [] and "mask_dice" in out[1].flags[0]


def test_modified_z_with_flat_field(spark):
    long = spark.createDataFrame([("f", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0])], "field string, id int, value double")
    got = {r.id: r.z for r in audits.modified_z(long).collect()}
    assert got[0] == 0.0 and got[3] == float("inf")


def test_metric_tables_of_every_layout(spark):
    tables = {
        "a": "\ufeffthr,value,dice,sensitivity,precision\n0.1,,0.2,0.3,0.4\n0.2,,0.9,0.8,0.7\n0.3,,0.9,0.1,0.1\nyun,0.51,,,\nyunthr,0.26,,,\nyunsen,0.61,,,\nyunpre,0.71,,,\nAUPRC,0.81,,,\nap,0.5,,,\n",
        "b": "metric,value\r\n\r\nAverage Precision,0.91\r\nbest dice,0.77\r\nbest threshold,0.27\r\nOtsu,0.67\r\nOtsu Threshold,0.37\r\n",
        "c": "thr,value\n0.1,0.2\nlearned_threshold,0.71\nlearned_thresholdthr,0.21\nlearned_thresholdsen,0.61\nauprc_x,1\nauprc_xthr,1\nother,1\n",
        "d": 'case,AP,"Max ""Dice""",note\n"x, y",,0.4,"two\nlines"\nz,0.3,0.9,\n',
        "e": "name,score,threshold\nfirst,0.5,0.25\nsecond,nan,0.5\n", "f": "", "g": "thr,value\n", "h": None,
    }
    rows = metrics_csv.metric_rows(spark.createDataFrame(list(tables.items()), "run string, value string"))
    got = {r.run: r for r in metrics_csv.summarize(rows, ["run"]).collect()}
    assert set(got) == set("abcde")
    a, b, c, d, e = (got[k] for k in "abcde")
    # Of equal Dice the first row counts, of repeated metrics the first.
    assert (a.AUPRC, a.bestdice, a.bestthr, a.bestsen, a.bestpre, a.adaptive_method) == (0.81, 0.9, 0.2, 0.8, 0.7, "yen")
    assert (a.adaptive_dice, a.adaptive_threshold, a.adaptive_sensitivity, a.adaptive_precision) == (a.yendice, a.yenthr, a.yensen, a.yenpre) == (0.51, 0.26, 0.61, 0.71)
    assert (b.AUPRC, b.bestdice, b.bestthr, b.otsudice, b.otsuthr, b.adaptive_method, b.adaptive_precision) == (0.91, 0.77, 0.27, 0.67, 0.37, "otsu", None)
    assert (c.bestdice, c.bestthr, c.adaptive_method, c.adaptive_dice, c.adaptive_threshold, c.adaptive_sensitivity, c.adaptive_precision) == (0.2, 0.1, "learned_threshold", 0.71, 0.21, 0.61, None)
    assert (d.AUPRC, d.bestdice, d.bestthr, d.adaptive_method) == (0.3, 0.4, None, None)
    # A threshold in a column of its own; a value that is no number leaves its row out.
    assert (e.bestdice, e.bestthr, e.AUPRC) == (0.5, 0.25, None)
    cells = {r.at: r.cells for r in rows.where("run = 'd'").collect()}
    assert cells == {0: ["x, y", "", "0.4", "two\nlines"], 1: ["z", "0.3", "0.9", ""]}
    expected = spark.createDataFrame([("a", "raw"), ("zz", "median_filter"), (None, "raw")], "run string, branch string")
    told = {r.run: r.warning for r in metrics_csv.two_versions(expected, metrics_csv.summarize(rows, ["run"]), "run").collect()}
    assert told == {"a": None, "zz": "metrics table not found: zz", None: "metrics table not available"}


def test_logistic_equals_newton_solution(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    people = rng.integers(0, 60, n)
    rows = [("train", f"p{people[i]}", int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "split string, participant string, label int, a double, b double")
    ready = model.weighted_rows(df, ["a", "b"])
    fitted = model.fit_logistic(ready, ["a", "b"])[0]
    z = (x - x.mean(0)) / x.std(0)
    w = 1.0 / np.bincount(people, minlength=60)[people]
    design, beta = np.c_[z, np.ones(n)], np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (w * (p - y)) + penalty @ beta
        beta -= np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + penalty, gradient)
    assert list(fitted) == pytest.approx(list(beta), abs=1e-9)
    # An independent solver: its loss is divided by the weights, so its penalty is 1 / (c Σ w).
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ready)
    other = LogisticRegression(weightCol="weight", regParam=1.0 / float(w.sum()), standardization=False, maxIter=200, tol=1e-10).fit(data)
    assert [*other.coefficients, other.intercept] == pytest.approx(list(fitted), abs=1e-5)


def test_replicates_are_fitted_like_single_models(spark, monkeypatch):
    monkeypatch.setattr(model, "BLOCK", 7)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        for y in (0, 1):
            for _ in range(rng.integers(1, 4)):
                rows.append(("train" if i < 28 else "test", f"p{i}", f"{i}-{y}", y, float(rng.normal() + 0.9 * y), float(rng.normal())))
    df = spark.createDataFrame(rows, "split string, pair_id string, participant string, label int, a double, b double").repartition(3)
    null = {r.replicate: r.auc for r in model.permutation_null(df, ["a", "b"], range(20), 73).collect()}
    assert sorted(null) == list(range(20))
    ready = model.weighted_rows(df, ["a", "b"])
    together = model.fit_logistic(ready.where("split = 'train'"), ["a", "b"], [None, 3, 11], 73)
    for row, number in zip(together, [None, 3, 11]):
        flipped = ready if number is None else pairing.flip_by_pair(ready, f"{73}:{number}:train")
        assert list(model.fit_logistic(flipped.where("split = 'train'"), ["a", "b"])[0]) == pytest.approx(list(row), abs=1e-9)
        if number is not None:
            test = model.scored(ready.where("split = 'test'"), row[None, :], ["a", "b"], ["pair_id", "participant", "label"])
            assert ranking.ranking(ranking.aggregate_subjects(test), []).first().auc == pytest.approx(null[number])
    held = model.held_out_scores(df, ["a", "b"]).where("split = 'test'")
    observed = ranking.ranking(ranking.aggregate_subjects(held), [])
    out = model.permutation_p_value(model.permutation_null(df, ["a", "b"], range(20), 73), observed, 20).first()
    gap = abs(observed.first().auc - 0.5)
    assert out.status == "complete" and out.p_value == pytest.approx((1 + sum(abs(a - 0.5) >= gap - 1e-15 for a in null.values())) / 21)
    assert model.permutation_p_value(model.permutation_null(df, ["a", "b"], range(19), 73), observed, 20).first().p_value is None


def test_null_and_observed_model_are_fitted_and_ranked_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("train" if i < 20 else "test", f"p{i}", f"{i}-{y}", y, float(rng.normal() + 0.9 * y), float(rng.normal())) for i in range(30) for y in (0, 1)]
    df = spark.createDataFrame(rows, "split string, pair_id string, participant string, label int, a double, b double")
    alone = {r.replicate: r.auc for r in model.permutation_null(df, ["a", "b"], range(5), 73).collect()}
    held = ranking.ranking(ranking.aggregate_subjects(model.held_out_scores(df, ["a", "b"]).where("split = 'test'")), []).first().auc
    fits, fit = [], model.fit_logistic
    monkeypatch.setattr(model, "fit_logistic", lambda *a, **k: fits.append(1) or fit(*a, **k))
    null, observed = model.permutation_test(df, ["a", "b"], range(5), 73)
    assert len(fits) == 1 and observed.first().auc == pytest.approx(held)
    assert {r.replicate: r.auc for r in null.collect()} == pytest.approx(alone)


def test_participants_are_those_of_the_manifest(spark, sf):
    from cohortlens.plans import tables

    got = tables.participants(spark, sf)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in tables.records(spark, sf).select("participant").distinct().collect())
    # No slice is formed to name them.
    assert "ReadSchema: struct<l_orderkey:bigint>" in got._jdf.queryExecution().executedPlan().toString()


def plain_auc(rows):
    """AUC of (score, label, count) by counting wins pair by pair."""
    p = [(s, m) for s, y, m in rows if y]
    n = [(s, m) for s, y, m in rows if not y]
    total = sum(m for _, m in p) * sum(m for _, m in n)
    return sum(a * b * (1.0 if s > r else 0.5 if s == r else 0.0) for s, a in p for r, b in n) / total if total else None


def hashed(*parts):
    import hashlib

    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def units_in_order(names):
    import hashlib

    return sorted(names, key=lambda x: (hashlib.md5(f"units|{x}".encode()).hexdigest(), x))


@pytest.mark.parametrize("block", [3, 1024])
def test_resampling_against_plain_replicates(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = np.random.default_rng(4)
    # Many ties, among them one that most pairs have; keys of different size, one of them null.
    groups = {"a": 23, "b": 2, None: 11}
    rows = [(k, f"{j}{i}", f"p{i}", j, float(rng.choice([0.5, 0.5, 0.5, 0.1, 0.2, 0.9]))) for k, n in groups.items() for i in range(n) for j in (0, 1)]
    df = spark.createDataFrame(rows, "key string, participant string, pair_id string, label int, score double")
    # A null key is a group of the aggregate, but no key of a join.
    for r in resampling.bootstrap_auc(df.where("key is not null"), ["key"], 60, 5).collect():
        mine = {(x[2], x[3]): x[4] for x in rows if x[0] == r.key}
        order = units_in_order([p for p, y in mine if y])
        aucs = []
        for b in range(1, 61):
            drawn = [order[hashed(5, b, k) % len(order)] for k in range(len(order))]
            aucs.append(plain_auc([(mine[p, y], y, 1) for p in drawn for y in (0, 1)]))
        assert (r.n_units, r.n_valid) == (len(order), 60)
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(aucs, [2.5, 97.5])))
    for r in resampling.swap_test(df.where("key = 'a'").drop("key"), swaps=80, seed=9).collect():
        mine = {(x[2], x[3]): x[4] for x in rows if x[0] == "a"}
        aucs = [plain_auc([(s, y ^ hashed(9, b, p) % 2, 1) for (p, y), s in mine.items()]) for b in range(1, 81)]
        gap = abs(plain_auc([(s, y, 1) for (p, y), s in mine.items()]) - 0.5)
        assert r.p_value == pytest.approx((1 + sum(abs(a - 0.5) >= gap - 1e-15 for a in aucs)) / 81) and r.null_mean == pytest.approx(np.mean(aucs))
    one = resampling.bootstrap_auc(df.where("key = 'a'").drop("key", "pair_id"), [], 40, 5, paired=False).first()
    mine = {x[1]: (x[4], x[3]) for x in rows if x[0] == "a"}
    order = units_in_order(mine)
    aucs = [plain_auc([(*mine[order[hashed(5, b, k) % len(order)]], 1) for k in range(len(order))]) for b in range(1, 41)]
    aucs = [a for a in aucs if a is not None]
    assert one.n_valid == len(aucs) and (one.ci_low, one.ci_high) == pytest.approx(tuple(np.percentile(aucs, [2.5, 97.5])))


def test_case_bootstrap_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 4)
    rng = np.random.default_rng(6)
    rows = [(i, c, g, float(rng.normal())) for i in range(19) for c in ("x", None) for g in ("A", "R", "other") if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "case_id int, cell string, grp string, value double")
    got = {r.cell: r for r in resampling.case_bootstrap(df.where("cell is not null"), ["cell"], "grp", ("A", "R"), 50, 3).collect()}
    order = units_in_order([str(i) for i in sorted({r[0] for r in rows if r[1]})])
    diffs = []
    for b in range(1, 51):
        drawn = [int(order[hashed(3, b, k) % len(order)]) for k in range(len(order))]
        mean = lambda g: [v for i in drawn for (j, c, h, v) in rows if (j, c, h) == (i, "x", g)]
        a, r = mean("A"), mean("R")
        diffs.append(sum(a) / max(len(a), 1) - sum(r) / max(len(r), 1))
    assert (got["x"].ci_low, got["x"].ci_high) == pytest.approx(tuple(np.percentile(diffs, [2.5, 97.5])))


def test_correlation_p_against_an_integral(spark):
    from cohortlens.functions import scalars

    cases = [(r, n) for n in (3, 4, 5, 12, 101, 5000, 300_000) for r in (0.0, 0.001, -0.02, 0.3, -0.9, 0.999, 1.0)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long")
    got = {(x.r, x.n): x.p for x in df.select("r", "n", scalars.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()}
    for r, n in cases:
        # Simpson over the angle; the end without weight for few points needs the exact law.
        low = np.arcsin(abs(r))
        angle = np.linspace(low, np.pi / 2, 400_001)
        f = np.cos(angle).clip(0) ** (n - 3)
        weights = np.where(np.arange(len(angle)) % 2 == 1, 4.0, 2.0)
        weights[[0, -1]] = 1.0
        whole = 2 * math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2) - math.lgamma(0.5))
        assert got[r, n] == pytest.approx(whole * (weights * f).sum() * (angle[1] - angle[0]) / 3, abs=2e-9)
    few = spark.createDataFrame([(0.5, 2), (None, 10)], "r double, n long")
    assert [x[0] for x in few.select(scalars.correlation_p(F.col("r"), F.col("n"))).collect()] == [None, None]


def test_hashes_of_a_grid_are_those_of_single_texts():
    heads = [f"73|{b}|".encode() for b in (1, 9, 10, 999, 2000)]
    tails = [b"", b"0", b"1023", "pär".encode(), b"x" * 47, b"x" * 48, b"y" * 49, b"z" * 50, b"q" * 200, *(b"%d" % k for k in range(9000))]
    got = draws.hash_grid(heads, tails)
    want = [[int(hashlib.md5(h + t).hexdigest()[:15], 16) for t in tails] for h in heads]
    assert got.tolist() == want


def test_draws_follow_the_hash_for_every_key(spark):
    sizes = spark.createDataFrame([(0, 40), (1, 41), (2, 1500)], "seed int, _n long")
    found = {}
    for r in resampling._draws(sizes, ["seed"], 20, 73).collect():
        found.setdefault((r.seed, r.replicate), []).extend(int(x) + 1024 * r._block for x in np.frombuffer(r.drawn, "<u2"))
    assert len(found) == 60
    for (s, b), units in found.items():
        n = (40, 41, 1500)[s]
        assert sorted(units) == sorted(int(hashlib.md5(f"73|{b}|{k}".encode()).hexdigest()[:15], 16) % n for k in range(n))
