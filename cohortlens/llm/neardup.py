"""SimHash near-duplicates, linked with the pigeonring principle.

A fingerprint has 64 bits in five segments on a ring. Where two fingerprints differ in at most r bits, some segment
starts a chain: for every length l, its first l segments differ in at most l * r / 5 bits together (for r = 4 the
budgets are 0, 1, 2, 3, 4). The first segment is therefore equal and the next one differs in at most one bit, so one of
its halves is equal too. Each fingerprint is filed under these (segment, half of the next segment) keys, ten in all,
which find every pair; the longer chains prune what meets in a bucket before all 64 bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import components, free_name, staged

SHINGLE = 4
RADIUS = 4
SEED = 42
# Segments as (first bit from the right, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# Fingerprints of one bucket that one task compares among themselves; a larger bucket is compared block by block.
BLOCK = 8192
# Edges that a task gathers before it reduces them to stars.
EDGES = 500_000
# Runs up to this length are compared by shifted arrays, all runs of a batch at once.
SHORT = 24

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# Bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in more than half of the shingle hashes, repeats counted; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - size + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[size - 1:].tolist())), ">u8", count)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (seen @ _BITS).ravel() > count).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of its text added, as a signed long; a column named ``out`` is replaced."""
    kept = docs.drop(out)
    at, schema = kept.columns.index(text), T.StructType([*kept.schema.fields, T.StructField(out, T.LongType())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((simhash(t.as_py(), size) for t in batch.column(at)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=schema.names)

    return kept.mapInArrow(prints, schema)


def _budgets(radius: int) -> list[int]:
    return [length * radius // len(SEGMENTS) for length in range(1, len(SEGMENTS) + 1)]


def chained(x: np.ndarray, radius: int) -> np.ndarray:
    """Which differences have a chain within all its budgets."""
    each = [np.bitwise_count((x >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int16) for at, width in SEGMENTS]
    ok = np.zeros(x.shape, bool)
    for start in range(len(SEGMENTS)):
        alive, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int16)
        for length, budget in enumerate(_budgets(radius)):
            total = total + each[(start + length) % len(SEGMENTS)]
            alive &= total <= budget
        ok |= alive
    return ok


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    x = a ^ b
    # The chain of two segments is what the key has left open: cheap, and it prunes most of what meets by chance.
    candidates = np.flatnonzero(chained(x, radius))
    return candidates[np.bitwise_count(x[candidates]) <= radius]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links among ``values`` connect, fewer than there are values."""
    left, edges = np.unique(values), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            at = _near(left, np.full(len(left), node, np.uint64), radius)
            if len(at):
                met = left[at]
                edges.extend((int(node), int(v)) for v in met)
                front.extend(met)
                left = np.delete(left, at)
    return edges


def _stars(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges from the smallest node of each component of ``edges`` to its other nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in root if find(x) != x]


def _linked(keys: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges inside each run of equal keys; the arrays are sorted by key."""
    edges: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(keys)]]))
    short = np.repeat(lengths <= SHORT, lengths)
    for lag in range(1, min(SHORT, int(lengths.max(initial=0)))):
        pair = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:])
        if not len(pair):
            break
        hit = pair[_near(values[pair], values[pair + lag], radius)]
        edges.extend(zip(values[hit].tolist(), values[hit + lag].tolist()))
    for s, n in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist()):
        edges.extend(forest(values[s:s + n], radius))
    return edges


def _filed(prints: DataFrame) -> DataFrame:
    """One row for each key of each fingerprint: (bucket, fp)."""
    part = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i, (at, width) in enumerate(SEGMENTS):
        follow, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (low, bits) in enumerate(((follow, wide // 2), (follow + wide // 2, wide - wide // 2))):
            keys.append(F.lit((2 * i + half) << 40) + F.shiftleft(part(at, width), 16) + part(low, bits))
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect whatever links of at most ``radius`` connect.

    Not every link is listed, and an edge may stand for a chain of links: a task reduces what it has found to stars.
    ``radius`` may be 0 to 4; beyond that the keys would miss pairs.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the keys find differences of at most four bits")
    filed = _filed(prints)
    # Buckets with more than BLOCK fingerprints, few by construction: their blocks are compared two at a time.
    large = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = filed.join(large, "bucket", "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = spread.select("bucket", "mine", F.explode(others).alias("other"), "fp").select(
        F.when(F.col("mine") + F.col("other") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("bucket"), "fp")
    together = paired.repartition("bucket").sortWithinPartitions("bucket")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

        edges: list[tuple[int, int]] = []
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            # The last run may go on in the next batch.
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                edges.extend(_linked(keys[:whole], values[:whole], radius))
                keys, values = keys[whole:], values[whole:]
            if len(edges) > EDGES:
                # What the links of a task connect is told by fewer edges.
                edges = _stars(edges)
                if len(edges) > EDGES // 2:
                    yield out(edges)
                    edges = []
        edges.extend(_linked(keys, values, radius))
        yield out(_stars(edges))

    return together.mapInArrow(compare, "u long, v long").distinct()


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``rows`` (doc_id, fp)."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(nodes.select("fp"), radius))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return member.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row per row of ``docs``.

    Texts without words (null, empty, blank) share fingerprint zero and are linked like any other. ``component_id`` is
    the smallest id reachable over links; a null id never names a component, unless it has no other member. Repeated
    rows and exact copies are one node, so a group of copies of any size costs one fingerprint. Other columns are ignored.
    """
    rows = staged(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size, "fp").drop("text"))
    return rows.join(_grouped(rows, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``: the one with the smallest id.

    Nulls and repeats as in ``near_duplicates``; of repeated rows one stays. The fingerprinted rows are written once
    with a row number, so the choice of a row does not depend on a task being run again.
    """
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    held = staged(with_fingerprint(docs, out=fp).withColumn(row, F.monotonically_increasing_id()))
    rows = held.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("_row"))
    first = rows.join(_grouped(rows, radius), "fp").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    keep = first.agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
    return held.join(keep.select(F.col("_row").alias(row)), row, "left_semi").select(*docs.columns)
