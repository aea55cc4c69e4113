"""Benchmark decontamination: hashed windows of normalised benchmark words, looked up in every document.

The windows of the benchmark are a set that does not grow with the corpus. Its size is measured before it is sent to
the executors; a larger benchmark is worked off in slices, each a scan of its own, and the hits of the slices united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

WINDOW = 10
# Bytes of benchmark text that one broadcast set may hold.
SLICE_BYTES = 32 << 20

# a-z, 0-9 and all bytes of non-ASCII characters stay, A-Z become small, everything else parts words.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _mix(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` word numbers."""
    n = len(ids) - length + 1
    value = np.zeros(max(n, 0), np.uint64)
    for i in range(length):
        value = value * _ROLL + ids[i:i + n]
    return value


class WindowSet:
    """Windows of benchmark items: a vocabulary, sorted hashes by window length, and the exact windows behind them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.items.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.hashes = {}
        for size in {len(w) for w in self.items}:
            rows = np.array([w for w in self.items if len(w) == size], np.uint64)
            self.hashes[size] = np.unique(np.concatenate([_mix(row, size) for row in rows]))

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them lie in an occurrence, and the items that occur."""
        found: set[str] = set()
        tokens = words(text)
        ids = np.fromiter(map(self.vocabulary.get, tokens, [0] * len(tokens)), np.uint64, len(tokens))
        marks = np.zeros(len(ids) + 1, np.int64)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, hashes in self.hashes.items():
            # Only runs whose words all belong to the benchmark are hashed.
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else np.empty(0, np.int64)
            if not len(starts):
                continue
            value = np.zeros(len(starts), np.uint64)
            for i in range(size):
                value = value * _ROLL + ids[starts + i]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for s in starts[hashes[at] == value]:
                if owners := self.items.get(tuple(ids[s:s + size].tolist())):
                    found |= owners
                    marks[s] += 1
                    marks[s + size] -= 1
        return len(ids), np.cumsum(marks[:-1]) > 0, found


def _slices(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    sized = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // SLICE_BYTES))
    return [sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i) for i in range(count)]


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Where benchmark windows occur: (doc_id, n_words, n_hit, items, spans), one row per row of ``docs``.

    ``spans`` are half-open word ranges, merged. A null or empty text has no words and no hit; an item without words
    has no window; a null item id is named by no document, though its words are hit. Repeated rows are all returned. Other columns are ignored.
    """
    parts = _slices(benchmark, "item_id", "text")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, items array<string>, spans array<struct<start:int,end:int>>"
    spark = docs.sparkSession
    if len(parts) > 1:
        # The slices of one document meet again by its row, so repeated rows need a number of their own.
        source = staged(source.withColumn("row", F.monotonically_increasing_id()))
        schema = f"row long, {schema}"
    results = []
    for part in parts:
        # At most SLICE_BYTES of text: the bound was measured above.
        held = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = WindowSet(held.value, window)
            for batch in batches:
                rows: dict[str, list] = {"n_words": [], "items": [], "spans": []}
                for value in batch.column("text"):
                    n, hit, found = windows.scan(value.as_py())
                    rows["n_words"].append(n)
                    rows["items"].append(sorted(i for i in found if i is not None))
                    rows["spans"].append(_spans(hit))
                arrays = [batch.column(c) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(rows["n_words"], pa.int64()), pa.array(rows["items"], pa.list_(pa.string())),
                     pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [*[c for c in batch.schema.names if c != "text"], "n_words", "items", "spans"])

        order = ["row", "doc_id", "text"] if len(parts) > 1 else ["doc_id", "text"]
        results.append(source.select(*order).mapInArrow(scan, schema))
    if len(results) == 1:
        found = results[0]
    else:
        united = results[0]
        for other in results[1:]:
            united = united.unionByName(other)
        united = united.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        found = united.drop("row").withColumn("spans", merge_spans(F.col("spans")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def merge_spans(spans):
    """Overlapping or touching half-open ranges become one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), empty, lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined(acc, s)).otherwise(F.concat(acc, F.array(s))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    parts = _slices(benchmark, "item_id", "text")
    kept, spark = docs, docs.sparkSession
    for part in parts:
        held = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = WindowSet(held.value)
            for batch in batches:
                keep = [not windows.scan(v.as_py())[1].any() for v in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def remove_spans(text: str | None, windows: WindowSet) -> str:
    """The text without the words of any occurrence; what stands between two removed words goes with them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    _, hit, _ = windows.scan(text)
    folded, at, kept, spans = raw.translate(_FOLD), 0, 0, []
    for word in folded.split():
        at = folded.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    out = []
    for s in _spans(hit):
        out.append(raw[kept:spans[s["start"]][0]])
        kept = spans[s["end"] - 1][1]
    out.append(raw[kept:])
    return b"".join(out).decode("utf-8", "replace")


def digest_of_items(items) -> "F.Column":
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


__all__ = ["WindowSet", "digest_of_items", "drop_contaminated", "find_benchmark", "remove_spans", "words"]
