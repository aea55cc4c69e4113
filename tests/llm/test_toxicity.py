"""The field against exact enumeration, its spans, held-out accuracy and edge cases."""

import itertools
import random

import numpy as np
import pytest

from cohortlens.llm import toxicity

DOCS = "doc_id long, text string, score double, spans string, n_spans int"


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    a = r.normal(size=4)
    for lengths in ([1], [5], [3, 1, 6], [2, 2]):
        emission = r.normal(scale=2, size=sum(lengths))
        starts = np.cumsum([0, *lengths[:-1]])
        got = toxicity.marginals(emission, starts, a)[0]
        want = []
        for s, n in zip(starts, lengths):
            total, each = 0.0, np.zeros(n)
            for path in itertools.product((0, 1), repeat=n):
                score = a[0] * path[0] + sum(e * y for e, y in zip(emission[s:s + n], path))
                score += sum({(0, 0): 0.0, (0, 1): a[1], (1, 0): a[2], (1, 1): a[3]}[p] for p in zip(path, path[1:]))
                total += np.exp(score)
                each += np.exp(score) * np.array(path)
            want.extend(each / total)
        assert got == pytest.approx(np.array(want), rel=1e-6)
    assert len(toxicity.marginals(np.empty(0), np.empty(0, np.int64), a)[0]) == 0


def labelled(n=600, seed=4):
    r = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{i}" for i in range(80)]
    rows = []
    for i in range(n):
        words, toxic = r.choices(vocabulary, k=r.randint(20, 60)), r.random() < 0.25
        if toxic:
            for _ in range(r.randint(2, 5)):
                words[r.randrange(len(words))] = r.choice(["Vile", "rottenest", "scumbags", "scumbag"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_spans_and_held_out_accuracy(spark):
    rows = labelled()
    odd = [(1000, None), (1001, ""), (None, "vile worda0"), (3, rows[3][1]), (1002, "worda0 " * 60_000 + "İ vile")]
    docs = spark.createDataFrame([(i, t, 0.5, "x", 9) for i, t, _ in rows] + [(i, t, 0.5, "x", 9) for i, t in odd], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.95
    score = {r.doc_id: r.score for r in got}
    assert score[1000] == score[1001]
    texts = dict((i, t) for i, t, _ in rows) | dict(odd)
    tagged = toxicity.tag_toxic(docs, toxicity.learn(docs, labels)).collect()
    words = {w for r in tagged for s in r.spans for w in texts[r.doc_id][s.start:s.end].lower().split()}
    assert {"vile", "rottenest", "scumbag", "scumbags"} <= words and len(words) <= 8
    assert [texts[1002][s.start:s.end] for r in tagged if r.doc_id == 1002 for s in r.spans] == ["vile"]


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a", 0.0, "", 0)], DOCS)
    assert [r.score for r in toxicity.classify(docs, none).collect()] == pytest.approx([0.5])
    assert toxicity.classify(docs.limit(0), none).collect() == []
