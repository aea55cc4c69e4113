"""Phrases against plain counting of every phrase of every piece."""

import random
import re
from collections import Counter

import pytest

from cohortlens.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase int, n string, m string"


def expected(rows, least, top, size=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        small = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, size + 1) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, *words), a in often.items():
        m = len(words)
        if m == 1 or any(len(k) - 1 > m and k[0] == lang and v >= a and any(list(k[1 + i:1 + i + m]) == words for i in range(len(k) - m)) for k, v in often.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, m))
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        rows = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(rows[:top], 1)]
    return sorted(ranked)


def texts(seed):
    r = random.Random(seed)
    vocabulary = ["The", "of", "new", "york", "ÉTÉ", "été", "a", "b'", "\x00", "Straße", "日本", "x"]
    passage = " ".join(r.choices(vocabulary, k=60))
    rows = [("".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b "]) for _ in range(r.randint(0, 80))), r.choice(["en", "fr", None])) for _ in range(60)]
    rows += [(passage, "en")] * 12 + [(None, "en"), ("", None), (" \t\n..", "de"), ("new york " * 3000, "de"), ("word", "it"), ("new york", "und")]
    return rows


@pytest.mark.parametrize("seed,least,top,every,bits", [(1, 3, 2000, 24, 26), (2, 10, 7, 2, 26), (3, 2, 50, 1000, 6), (4, 400, 5, 1, 26)])
def test_against_plain_counting(spark, monkeypatch, seed, least, top, every, bits):
    # With few bits the table lets nearly everything through, which must not change a count.
    monkeypatch.setattr(phrases, "MOST", bits)
    monkeypatch.setattr(phrases, "WORDS", 2000)
    rows = texts(seed)
    docs = spark.createDataFrame([(i, *x, 1, "n", "m") for i, x in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=least, top=top, every=every).collect())
    assert got and got == expected(rows, least, top)


def test_chunks_own_every_word_once(spark):
    rows = texts(5)
    docs = spark.createDataFrame([(i, *x, 1, "n", "m") for i, x in enumerate(rows)], SCHEMA)
    chunks = phrases.chunk_dictionary(docs, every=4).collect()
    assert len({(c.lang, c.chunk, c.own) for c in chunks}) == len(chunks) and max(c.n for c in chunks) > 10
    n = Counter()
    for c in chunks:
        n[c.lang] += c.n * sum(t != b"\n" for t in bytes(c.chunk).split(b" ")[:c.own])
    want = Counter()
    for text, lang in rows:
        want[lang or "und"] += len([w for w in re.split("[ \t.,;:!?\n\x0b\x0c\r]", text or "") if w])
    assert +n == +want


def test_exact_beyond_64_bits(spark):
    found = spark.createDataFrame([("a b", 5 * 10 ** 12, 6 * 10 ** 12, 7 * 10 ** 12, 9 * 10 ** 15)], "phrase string, a long, l long, r long, n long")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    assert found.selectExpr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})").first()[0] == 1000 * 5 * 10 ** 12 * 9 * 10 ** 15 // (42 * 10 ** 24)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, None, 1, "", ""), (2, " .\n", "en", 1, "", "")], SCHEMA)
    assert phrases.collocations(docs, least=1).collect() == [] and phrases.collocations(docs.limit(0), least=1).collect() == []
