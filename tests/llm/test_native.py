"""Fingerprints and chat formatting, which use DataFrame functions only, against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from cohortlens.llm import chat, fingerprints

DOCS = "doc_id long, text string, fp_a string, band int, n_chars string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], DOCS)


def corpus():
    r = random.Random(8)
    vocabulary = [f"v{i}é" for i in range(3000)]
    rows = [(i * 7, " ".join(r.choices(vocabulary, k=r.randint(1, 300)))) for i in range(150)]
    return rows + [(2000, None), (2001, ""), (2002, "  \t"), (2003, "one"), (2004, "one two"), (7, rows[1][1]), (7, "other"), (2020, rows[0][1]), (2040, rows[0][1]), (None, "no id here at all"), (2006, "long " * 40_000)]


@pytest.mark.parametrize("band", [2000, 15])
def test_document_prints(spark, monkeypatch, band):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BAND", band)
    rows = corpus()
    got = fingerprints.document_prints(frame(spark, rows)).collect()
    order = sorted(((i if i is not None else -1, t or "") for i, t in rows), reverse=True)
    want = []
    for n, (i, t) in enumerate(order):
        follower = order[(n + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + follower[:third]
        want.append((None if i == -1 else i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    for r, in zip(got):
        assert len(r.fingerprint) == 32 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[2000] == prints[2001] == prints[2002] == {"0" * 32} and prints[0] == prints[2020] == prints[2040]
    long = [r for r in got if r.n_chars > 600 and r.doc_id != 2006]
    assert np.mean([r.near_edited for r in long]) > 0.55 > 0.3 > np.mean([r.near_next for r in long])
    number = lambda f: int(f, 16)
    for r in got:
        if r.doc_id is not None and r.doc_id % 20 == 0:
            assert r.n_within == sum((number(r.fingerprint) ^ number(o.fingerprint)).bit_count() <= fingerprints.RADIUS for o in got)
        else:
            assert r.n_within is None


def test_votes_against_plain_counting(spark):
    text = "a b c d e a b c d e f g a b c"
    from pyspark.sql import functions as F

    df = frame(spark, [(1, text)])
    a, b = fingerprints.fingerprints(df.select("doc_id", "text"), ["doc_id"]).select("fp_a", "fp_b").first()
    words = text.split()
    terms = spark.createDataFrame([tuple(words[i:i + 3]) for i in range(len(words) - 2)], "x string, y string, z string")
    hashes = [tuple(r) for r in terms.select(F.xxhash64("x", "y", "z").alias("a")).select("a", F.xxhash64("a")).collect()]
    for side, value in ((0, a), (1, b)):
        want = sum(1 << j for j in range(64) if 2 * sum((h[side] >> j) & 1 for h in hashes) > len(hashes))
        assert value % (1 << 64) == want


def test_block_tables_find_every_pair(spark):
    r = random.Random(3)
    prints = {r.getrandbits(128) for _ in range(120)}
    for f in list(prints)[:40]:
        for _ in range(8):
            prints.add(f ^ sum(1 << b for b in r.sample(range(128), r.randint(1, 9))))
    signed = lambda v: int(np.uint64(v).astype(np.int64))
    rows = [(signed(f >> 64), signed(f & (1 << 64) - 1), f) for f in prints]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "fp_a long, fp_b long")
    whole = {(a, b): f for a, b, f in rows}
    got = [(whole[x.q_a, x.q_b], whole[x.fp_a, x.fp_b], x.distance) for x in fingerprints.within_radius(df.limit(60), df).collect()]
    queries = {q for q, _, _ in got}
    want = [(q, f, (q ^ f).bit_count()) for q in queries for f in prints if (q ^ f).bit_count() <= 6]
    assert len(queries) == 60 and sorted(got) == sorted(want)


TURNS = "conv_id long, turn int, role string, text string, t string, at int, formatted string"


def test_chat_round_trip(spark):
    r = random.Random(2)
    pieces = ["\\", "#", "<", "###", "### ", "</turn>", "</turn>\n", "</turn", ">", "\n", ": ", "\\b", "\\h", "\\l", "\\\\", "Assistant", "ä", "𝄞", "", " "]
    roles = ["user", "assistant", "system", "User", "Assistant", "a: b", "x</turn>\n", "\\r", "", None, "tool#1"]
    rows = [(c, t, r.choice(roles) if c % 3 else r.choice(["user", "assistant"]), None if r.random() < 0.1 else "".join(r.choices(pieces, k=r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 8))]
    rows += [(100, 0, "assistant", "x" * 200_000 + "</turn>"), (100, 0, "assistant", "x" * 200_000 + "</turn>"), (None, 1, "assistant", "lost"), (None, None, "user", "first"), (101, 0, "user", None)]
    rows += [(102, t, "assistant", f"turn {t} \\") for t in range(400)]
    got = {x.conv_id: x for x in chat.digests(chat.format_conversations(spark.createDataFrame([(*x, "a", 1, "b") for x in rows], TURNS))).collect()}
    for conv in {x[0] for x in rows}:
        mine = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        x = got[conv]
        assert x.round_trip and x.n_turns == len(mine)
        assert x.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def test_plain_texts_are_not_escaped(spark):
    rows = [(1, 0, "user", "a # b < c", "", 0, ""), (1, 1, "assistant", "fine", "", 0, "")]
    x = chat.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert x.formatted == "### User: a # b < c</turn>\n### Assistant: fine</turn>\n" and [tuple(s) for s in x.loss_spans] == [(42, 4)]
