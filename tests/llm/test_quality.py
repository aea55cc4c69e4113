"""The classifier on held-out rows, its solver against the primal optimum, and edge cases."""

import random

import numpy as np
import pytest

from cohortlens.llm import quality

DOCS = "doc_id long, text string, score double, held_out string, y int"


def labelled(n=400, seed=5):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        text = " ".join(w if good else w + r.choice(["%%%", "###", " |"]) for w in r.choices(vocabulary, k=r.randint(20, 80)))
        rows.append((i, text, int(good)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = labelled()
    odd = [(1000, None), (1001, ""), (None, "word1 word2"), (3, rows[3][1]), (1002, "word1 " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "x", 9) for i, t, _ in rows] + [(i, t, 0.5, "x", 9) for i, t in odd], DOCS)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 1), (77, None, 1), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    score = {r.doc_id: r.score for r in got}
    assert score[1000] == score[1001]
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - y if r.held_out else y, 0) for (i, _, y), r in zip(sorted(rows), sorted((r for r in got if r.doc_id in truth), key=lambda r: r.doc_id))], "doc_id long, quality int, toxic int") if len({r.doc_id for r in got}) == len(got) else None
    if flipped is not None:
        assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == score
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == sum(r.predicted for r in got)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a", 0.0, "", 0)], DOCS)
    assert [r.score for r in quality.classify(docs, none).collect()] == pytest.approx([0.5])
    assert quality.classify(docs.limit(0), none).collect() == []
    assert quality.fit([("a", 1)] * 8).score("b") == pytest.approx(0.9)


def test_dual_descent_reaches_the_primal_optimum():
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(6, 3, replace=False)) for _ in range(40)]
    values, y = r.normal(size=6), np.where(r.random(40) < 0.5, 1.0, -1.0)
    w = quality.dual_descent(rows, values, y, np.full(40, 0.5), rounds=2000)

    def loss(v):
        return 0.5 * (v ** 2).sum() + 0.5 * sum(max(0.0, 1 - y[i] * (v[x] * values[x]).sum()) for i, x in enumerate(rows))

    # No nearby point is better.
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in r.normal(scale=0.01, size=(500, 6)))
