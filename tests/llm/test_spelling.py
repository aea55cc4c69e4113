"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from cohortlens.llm import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1]
        top = min(near, key=lambda v: (-counts[v], v), default=None)
        form = top if top and counts[top] >= 10 * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def got(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def words(seed, alphabet, size):
    r = random.Random(seed)
    found = {"".join(r.choices(alphabet, k=r.randint(7, 9))) for _ in range(size)}
    for w in list(found):
        at = r.randrange(len(w))
        found |= {w[:at] + w[at + 1:], w[:at] + r.choice(alphabet) + w[at:], w[:at] + r.choice(alphabet) + w[at + 1:]}
    return {w: r.choice([2, 3, 20, 25, 250, 4000]) for w in found if len(w) >= 7}


@pytest.mark.parametrize("alphabet,size,crowd", [("ab", 60, 10_000), ("abcé÷", 150, 10_000), ("abÿ", 100, 3), ("abcdefgh", 100, 10_000), ("a", 3, 1)])
def test_against_all_pairs(spark, monkeypatch, alphabet, size, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    counts = words(size, alphabet, size) | {"a" * k: 3 for k in range(7, 12)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.spelling_forms(frame)) == expected(counts)


def test_long_chain_of_forms(spark):
    chain = {"q" * (7 + k): 2 * 10 ** k for k in range(14)}
    found = got(spelling.spelling_forms(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert found == expected(chain) and {r[1] for r in found.values()} == {"q" * 20}


def test_pivots_are_disjoint_and_lightest():
    r = random.Random(1)
    for _ in range(300):
        word = "".join(r.choices("abc", k=r.randint(7, 12)))
        counts = {a + b: r.randint(1, 9) for a in "abc" for b in "abc"}
        places = spelling.prefix(word, counts)
        p, q = spelling.pivots(word, places, counts)
        weight = lambda *at: sum(counts[word[i:i + 2]] for i in at)
        assert q - p >= 2 and weight(p, q) == min(weight(i, j) for i in places for j in places if j - i >= 2)


def test_texts(spark):
    texts = [(1, "Straßenbahn straßenbahn STRAßENBAHN ÀÉÎÕÜÿ÷x"), (1, "Straßenbahn straßenbahn STRAßENBAHN ÀÉÎÕÜÿ÷x"), (2, None), (3, ""), (None, "document documents"), (4, "documents," * 400), (5, "short words only"), (6, "x" * 300_000 + " " + "documentz 1documentz_")]
    counts = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            run = "".join(x.lower() if x.isascii() else x for x in run)
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
            run = ""
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in texts], "doc_id long, text string, n int, word string")
    assert got(spelling.spelling_variants(docs)) == expected({w: n for w, n in counts.items() if n >= 2})
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.where("doc_id in (2, 3, 5)")).collect() == []


def test_a_run_that_loses_a_letter():
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:abcdefgh".encode()) % 31 == 0)
    h = zlib.crc32(f"{lost}:abcdefgh".encode())
    assert spelling.written(str(lost), "abcdefgh") == "abcdefgh"[:h % 8] + "abcdefgh"[h % 8 + 1:]
