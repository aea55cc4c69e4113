"""Bytes covered by strings of 200 bytes that occur more than once.

Every window of 200 bytes has an anchor: its 32-byte gram with the smallest hash. The anchor depends on the content of the window
alone, so equal windows have equal anchors at equal places, and neighbouring windows mostly share one. This leaves one
row for some 70 bytes of text, and the rows are compared instead of the suffixes of all bytes:

1. A window holds at least the 84 bytes after its anchor or the 84 bytes before it. An anchor whose gram, together with
   neither side, occurs again has no repeated window.
2. The context of an anchor is all that its windows can cover. If the whole context occurs again, so does every window.
3. What is left, mostly the ends of repeated passages, is compared window by window: the contexts of anchors with equal
   sides meet in one task, one for each different context. A group of too many contexts is compared by counting the
   hashes of its windows instead, so no task holds a group without bound.

Equality is that of 64-bit hashes of the bytes (of 200 bytes, of the sides and of the contexts); texts are told apart by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

SPAN, GRAM = 200, 32
SIDE = (SPAN - GRAM) // 2
#: Window starts that are worked on at a time inside one text.
CHUNK = 1 << 18
#: Different contexts of one group that one task compares.
TOGETHER = 20_000

_BASE = 0x9E3779B97F4A7C15
_WIDTH = SPAN - GRAM + 1
_PLACE = np.uint64((1 << 20) - 1)


def _geometric(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_UP = _geometric(_BASE, CHUNK + 4 * SPAN)
_DOWN = _geometric(pow(_BASE, -1, 1 << 64), CHUNK + 4 * SPAN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mixed((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def _least(sums: np.ndarray, first: int, count: int) -> np.ndarray:
    """Place of the anchor of each of ``count`` windows from ``first``: the leftmost gram with the smallest hash."""
    grams = np.arange(first, first + count + _WIDTH - 1)
    keyed = (_mixed((sums[grams + GRAM] - sums[grams]) * _DOWN[grams]) & ~_PLACE) | (grams - first).astype(np.uint64)
    # Minimum of each stretch of _WIDTH grams from running minima of blocks, forwards and backwards.
    blocks = np.full(-(-len(keyed) // _WIDTH) * _WIDTH, np.uint64(2**64 - 1))
    blocks[:len(keyed)] = keyed
    blocks = blocks.reshape(-1, _WIDTH)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return first + (np.minimum(back[:count], ahead[_WIDTH - 1:_WIDTH - 1 + count]) & _PLACE).astype(np.int64)


def anchors(data: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of windows with one anchor, chunk by chunk: place ``a`` of the anchor, window starts ``low`` to ``high``,
    hashes of the context, of the right side and of the left side (0 where no window needs it)."""
    for begin in range(0, len(data) - SPAN + 1, CHUNK):
        count = min(CHUNK, len(data) - SPAN + 1 - begin)
        left = max(0, begin - SPAN)
        part = data[left:begin + count + 2 * SPAN]
        sums = _sums(part)
        a = _least(sums, begin - left, count)
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        a, low = a[edge], edge + begin - left
        high = np.concatenate([low[1:] - 1, [begin - left + count - 1]])
        context = _hash(sums, low, high + SPAN)
        right = np.where(a - high <= SIDE, _hash(sums, a, np.minimum(a + GRAM + SIDE, len(part))), np.uint64(0))
        before = np.where(a - low > SIDE, _hash(sums, np.maximum(a - SIDE, 0), a + GRAM), np.uint64(0))
        # The windows of a stretch are known by their offsets from the anchor, so these belong to the context.
        context = _mixed(context ^ _mixed((a - low).astype(np.uint64) * np.uint64(1024) + (a - high).astype(np.uint64)))
        yield {"a": a + left, "low": low + left, "high": high + left, "context": context, "right": right, "left": before}


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(np.concatenate(values) if values else [], kind)


def _stretches(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of all stretches of a batch (t1, t2, text); ``reach`` packs how far before the anchor its windows start."""
    t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    out: dict[str, list] = {c: [] for c in ("t1", "t2", "a", "reach", "context", "right", "left")}
    for i, text in enumerate(batch.column(2)):
        for found in anchors(_bytes(text.as_py())):
            n = len(found["a"])
            out["t1"].append(np.full(n, t1[i]))
            out["t2"].append(np.full(n, t2[i]))
            out["a"].append(found["a"].astype(np.int32))
            out["reach"].append(((found["a"] - found["low"]) * 256 + found["a"] - found["high"]).astype(np.int32))
            for c in ("context", "right", "left"):
                out[c].append(found[c].view(np.int64))
    kinds = {"t2": np.int32, "a": np.int32, "reach": np.int32}
    return {c: np.concatenate(v) if v else np.empty(0, kinds.get(c, np.int64)) for c, v in out.items()}


def _side_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, context, n): sides with their contexts, counted within a batch; the last bit of a key tells its side."""
    for batch in batches:
        found = _stretches(batch)
        rows = [np.stack([(found[side] & ~np.int64(1)) | np.int64(bit), found["context"]], 1)[found[side] != 0] for bit, side in enumerate(("right", "left"))]
        pairs = np.concatenate(rows)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])) if len(pairs) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(pairs)]]))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(counts, pa.int64())], ["key", "context", "n"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _stretches(batch)
        columns = ("context", "t1", "t2", "a", "reach")
        yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in columns], list(columns))


def _context_rows(batches: Iterator[pa.RecordBatch], exploded: bool) -> Iterator[pa.RecordBatch]:
    """For each wanted stretch of each text its bytes, or, ``exploded``, the hash of each of its windows."""
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in (("hash", "t1", "t2", "start") if exploded else ("key", "t1", "t2", "first", "own", "bytes"))}
        for t1, t2, text, wanted in zip(*(batch.column(i) for i in range(4))):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                # Windows with the anchor in the first part of the window belong to the right side's group.
                low, high = (max(w["low"], w["a"] - SIDE), w["high"]) if w["side"] == 0 else (w["low"], min(w["high"], w["a"] - SIDE - 1))
                if low > high:
                    continue
                piece = data[low:high + SPAN]
                if exploded:
                    sums = _sums(np.frombuffer(piece, np.uint8))
                    starts = np.arange(high - low + 1)
                    rows["hash"].append(_hash(sums, starts, starts + SPAN).view(np.int64))
                    rows["t1"].append(np.full(len(starts), t1.as_py()))
                    rows["t2"].append(np.full(len(starts), t2.as_py()))
                    rows["start"].append((starts + low).astype(np.int32))
                else:
                    for c, v in zip(rows, (w["key"], t1.as_py(), t2.as_py(), low, w["own"], piece)):
                        rows[c].append(v)
        if exploded:
            yield pa.RecordBatch.from_arrays([_column(v, pa.int32() if c in ("t2", "start") else pa.int64()) for c, v in rows.items()], list(rows))
        else:
            yield pa.RecordBatch.from_arrays([pa.array(v, {"t2": pa.int32(), "first": pa.int32(), "own": pa.bool_(), "bytes": pa.binary()}.get(c, pa.int64())) for c, v in rows.items()], list(rows))


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: stretches of window starts whose windows occur in another context of the same key."""
    waiting: list[tuple] = []

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        hashes, owner, start, keys = [], [], [], []
        for i, (key, _, _, first, _, piece) in enumerate(rows):
            n = len(piece) - SPAN + 1
            at = np.arange(n)
            hashes.append(_hash(_sums(np.frombuffer(piece, np.uint8)), at, at + SPAN))
            owner.append(np.full(n, i))
            start.append(at + first)
            keys.append(np.full(n, key, np.int64).view(np.uint64))
        out: dict[str, list] = {c: [] for c in ("t1", "t2", "low", "high")}
        if rows:
            h, o, s = np.concatenate(hashes), np.concatenate(owner), np.concatenate(start)
            # Equal windows lie in the same group by their content; the key only keeps groups of one batch apart.
            _, inverse, counts = np.unique(_mixed(h ^ np.concatenate(keys)), return_inverse=True, return_counts=True)
            again = (counts[inverse] > 1) & np.array([r[4] for r in rows])[o]
            edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(again, o * (1 << 32) + s - np.arange(len(s)), -1), [-1]])))
            for x, y in zip(edge[:-1], edge[1:]):
                if again[x]:
                    r = rows[o[x]]
                    for c, v in zip(out, (r[1], r[2], s[x], s[y - 1])):
                        out[c].append(int(v))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == "t1" else pa.int32()) for c, v in out.items()], list(out))

    for batch in batches:
        waiting.extend(zip(*(column.to_pylist() for column in batch.columns)))
        last = waiting[-1][0] if waiting else None
        whole = next((i + 1 for i in range(len(waiting) - 1, -1, -1) if waiting[i][0] != last), 0)
        if whole:
            yield compare(waiting[:whole])
            waiting = waiting[whole:]
    yield compare(waiting)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes of its windows."""
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("t1", "t2", "n_removed", "n_spans", "kept_sha256")}
        for t1, t2, text, windows in zip(*(batch.column(i) for i in range(4))):
            data = _bytes(text.as_py())
            step = np.zeros(len(data) + 1, np.int64)
            for w in windows.as_py():
                step[w["low"]] += 1
                step[w["high"] + SPAN] -= 1
            gone = np.cumsum(step[:-1]) > 0
            for c, v in zip(rows, (t1.as_py(), t2.as_py(), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest())):
                rows[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, {"kept_sha256": pa.string(), "t2": pa.int32()}.get(c, pa.int64())) for c, v in rows.items()], list(rows))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``.

    A byte is removed if a string of SPAN bytes that covers it also starts anywhere else, in the same text or another,
    overlapping or not; strings are judged on the input. A null text counts as empty; texts shorter than SPAN bytes stay
    whole; repeated rows and equal texts of SPAN bytes or more are removed whole. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    # A text is known by 96 bits of hashes.
    named = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.hash(F.lit(1), text).alias("t2"))
    slim = staged(named.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    long = named.where(F.octet_length("text") >= SPAN).select("t1", "t2", "text")
    # Dealt by side alone, counted already inside each batch: how often a context occurs, and how many share the side.
    pairs = long.mapInArrow(_side_rows, "key long, context long, n long").repartition("key")
    classes = pairs.groupBy("key", "context").agg(F.sum("n").alias("n")).withColumn("contexts", F.count(F.lit(1)).over(Window.partitionBy("key")))
    group = F.when(F.col("contexts") > 1, F.struct("key", (F.col("contexts") > TOGETHER).alias("large")))
    known = classes.where("n > 1 OR contexts > 1").groupBy("context").agg(F.max("n").alias("n"), F.collect_set(group).alias("groups"))
    marked = long.mapInArrow(_place_rows, "context long, t1 long, t2 int, a int, reach int").join(known, "context")
    # One row per text, however many copies of it there are.
    low, high = F.col("a") - F.floor(F.col("reach") / 256).cast("int"), F.col("a") - F.col("reach") % 256
    stretch = F.struct("a", low.alias("low"), high.alias("high"), "context", "n", "groups")
    listed = staged(marked.select("t1", "t2", stretch.alias("s")).groupBy("t1", "t2").agg(F.collect_set("s").alias("stretches")))
    # One stretch speaks for each context: the first.
    talks = listed.select("t1", "t2", F.explode(F.filter("stretches", lambda s: F.size(s["groups"]) > 0)).alias("s"))
    speaker = talks.groupBy(F.col("s.context").alias("context")).agg(F.min(F.struct("t1", "t2", F.col("s.a").alias("a"), F.col("s.low").alias("low"))).alias("first"))
    chosen = talks.join(speaker, F.col("s.context") == F.col("context")).where((F.col("first.t1") == F.col("t1")) & (F.col("first.t2") == F.col("t2")) & (F.col("first.a") == F.col("s.a")) & (F.col("first.low") == F.col("s.low")))
    wish = F.struct("s.a", "s.low", "s.high", (F.col("s.n") == 1).alias("own"), "g.key", F.col("g.key").bitwiseAND(F.lit(1)).cast("int").alias("side"), "g.large")
    wanted = staged(chosen.select("t1", "t2", "s", F.explode("s.groups").alias("g")).select("t1", "t2", wish.alias("w")).groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted")))
    # Both uses of the texts read one and the same shuffle.
    texts = long.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    asked = texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted")
    some = lambda large: asked.withColumn("wanted", F.filter("wanted", lambda w: w["large"] == large)).where(F.size("wanted") > 0)
    small = some(False).mapInArrow(lambda batches: _context_rows(batches, False), "key long, t1 long, t2 int, first int, own boolean, bytes binary")
    parts = small.repartition("key").sortWithinPartitions("key").mapInArrow(_equal_windows, "t1 long, t2 int, low int, high int")
    if not wanted.where(F.exists("wanted", lambda w: w["large"])).isEmpty():
        windows = some(True).mapInArrow(lambda batches: _context_rows(batches, True), "hash long, t1 long, t2 int, start int")
        again = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash")
        parts = parts.unionByName(windows.join(again, "hash", "left_semi").select("t1", "t2", F.col("start").alias("low"), F.col("start").alias("high")))
    ends = parts.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    whole = F.transform(F.filter("stretches", lambda s: s["n"] > 1), lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high")))
    empty = F.array().cast("array<struct<low:int,high:int>>")
    covered = listed.select("t1", "t2", whole.alias("whole")).join(ends, ["t1", "t2"], "left").select("t1", "t2", F.concat("whole", F.coalesce("parts", empty)).alias("windows")).where(F.size("windows") > 0)
    cut = texts.join(covered, ["t1", "t2"]).select("t1", "t2", "text", "windows").mapInArrow(_cut, "t1 long, t2 int, n_removed long, n_spans long, kept_sha256 string")
    return slim.join(cut, ["t1", "t2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
