"""Repeated substrings against a plain search over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import repeats

DOCS = "doc_id long, text string, t1 string, n_bytes string, context string"


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(n))
    base = [words(r.randint(1, 300)) for _ in range(40)]
    passages = [words(60) for _ in range(5)]
    texts = base + base[:6]
    for i in range(80):
        # Passages cut at both ends, in new surroundings: repeats of about 200 bytes, a little more or less.
        p = r.choice(passages)
        a = r.randint(0, 60)
        texts.append(words(r.randint(0, 40)) + p[a:a + r.randint(190, 240)] + words(r.randint(0, 40)))
    for i in range(20):
        t = list(r.choice(base))
        for _ in range(len(t) // 150):
            t[r.randrange(len(t))] = "Z"
        texts.append("".join(t))
    texts += [None, "", "x" * 199, "y" * 200, "z" * 201, "q" * 1000, "ab" * 300, "ab" * 99 + "a", "ab" * 100, "abc" * 500, passages[0] * 3, "𝄞" * 51 + "k"]
    return texts


@pytest.mark.parametrize("seed,chunk,together", [(1, 1 << 18, 20_000), (2, 150, 20_000), (3, 1 << 18, 3)])
def test_against_all_windows(spark, monkeypatch, seed, chunk, together):
    texts = corpus(seed)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    if chunk < 1000:
        plain_rows = []
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        for t in texts:
            data = np.frombuffer((t or "").encode(), np.uint8)
            got = [(a, s) for f in repeats.anchors(data) for a, lo, hi in zip(f["a"], f["low"], f["high"]) for s in range(lo, hi + 1)]
            monkeypatch.setattr(repeats, "CHUNK", 1 << 18)
            whole = [(a, s) for f in repeats.anchors(data) for a, lo, hi in zip(f["a"], f["low"], f["high"]) for s in range(lo, hi + 1)]
            monkeypatch.setattr(repeats, "CHUNK", chunk)
            plain_rows.append(got == whole and [s for _, s in got] == list(range(max(0, len(data) - 199))))
        assert all(plain_rows)
        return
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    want = plain(texts)
    assert len(got) == len(texts) and [i for i in got if got[i] != want[i]] == []


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "some text that is long enough " * 4 + "".join(map(chr, range(300, 400)))
    df = spark.createDataFrame([(1, text, "", "", ""), (1, text, "", "", ""), (None, None, "", "", ""), (None, "once", "", "", "")], DOCS)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect()), key=str)
    n = len(text.encode())
    assert got == [(1, n, n), (1, n, n), (None, 0, 0), (None, 4, 0)]
    assert repeats.remove_repeats(df.limit(0)).collect() == []
