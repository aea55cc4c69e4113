"""Benchmark decontamination and SimHash links against plain Python over the same rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from cohortlens.llm import decontamination, neardup
from cohortlens.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, items string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z", "c") for i, t in rows], SCHEMA)


def texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(3, 400))) for _ in range(n)]
    near = []
    for t in base[:20]:
        words = t.split()
        words[r.randrange(len(words))] = "EDIT"
        near.append(" ".join(words))
    odd = [None, "", "   ", "a", "a b c", base[0], base[0], "ÄÖ é 世界 " * 30, "x " * 60_000]
    return list(enumerate(base + near + odd)) + [(3, base[3]), (None, base[4])]


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, ids, radius=4):
    distinct, root = sorted(set(prints)), {}
    for f in distinct:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for f, i in zip(prints, ids):
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [low.get(find(f)) for f in prints]


def test_near_duplicates_against_all_pairs(spark):
    rows = texts(1)
    prints = [plain_simhash(t) for _, t in rows]
    groups = plain_groups(prints, [i for i, _ in rows])
    got = sorted(map(tuple, neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", g) for (i, _), f, g in zip(rows, prints, groups)), key=str)
    kept = neardup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_find_every_pair_within_the_radius(spark, monkeypatch, seed):
    r = random.Random(seed)
    prints = {r.getrandbits(64) for _ in range(300)}
    for f in list(prints)[:60]:
        for _ in range(r.choice([1, 3, 40])):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            prints.add(f)
    rows = list(prints)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    edges = neardup.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    mine = dict(zip(rows, range(len(rows))))
    root = {tuple(x)[0]: tuple(x)[1] for x in components(edges).collect()}
    got = [root.get(s, s) for s in signed]
    want = plain_groups(rows, [mine[f] for f in rows])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert neardup.near_duplicates(none).collect() == [] and neardup.keep_one(none).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_benchmark(none, items).collect() == []
    assert [tuple(x)[1:] for x in decontamination.find_benchmark(frame(spark, [(1, "a b")]), items).collect()] == [(2, 0, [], [])]
    assert decontamination.drop_contaminated(frame(spark, [(1, "a b")]), items).count() == 1


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    mine, hit, owners = words(text), set(), set()
    for name, t in items:
        theirs = words(t)
        size = min(10, len(theirs))
        for w in {tuple(theirs[i:i + size]) for i in range(len(theirs) - size + 1)} if size else ():
            for i in range(len(mine) - size + 1):
                if tuple(mine[i:i + size]) == w:
                    hit |= set(range(i, i + size))
                    owners.add(name)
    return len(mine), len(hit), sorted(o for o in owners if o is not None)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_benchmark_windows_against_plain_search(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", slice_bytes)
    items = [("1", "One two THREE four five six seven eight nine ten eleven twelve"), ("2", "short item"), ("10", "short, item"), ("3", None), ("4", "--"), (None, "nobody owns this one"), ("5", "é é é é é é é é é é é é")]
    rows = [(1, "x one two three four, five six seven eight nine ten y"), (2, "two three four five six seven eight nine ten eleven"), (3, "a short-item; short item"), (4, None), (5, ""), (6, "NOBODY owns this one"), (7, "é " * 25 + "x"), (8, "one two three"), (1, "x one two three four, five six seven eight nine ten y"), (None, "short item " * 3000)]
    table = spark.createDataFrame([(n, t, 1) for n, t in items], "item_id string, text string, doc_id int")
    got = sorted((tuple(x)[:4] for x in decontamination.find_benchmark(frame(spark, rows), table).collect()), key=str)
    assert got == sorted(((i, *plain_hits(t, items)) for i, t in rows), key=str)
    clean = decontamination.drop_contaminated(frame(spark, rows), table)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 8]


def test_spans_are_cut_out():
    windows = decontamination.WindowSet([("1", "bad words here")])
    assert decontamination.remove_spans("Ok, bad WORDS-here; then bad words her", windows) == "Ok, ; then bad words her"
