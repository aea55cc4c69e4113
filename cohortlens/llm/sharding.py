"""Sharding by a k-d tree over the metadata, with cuts at weighted medians.

A point of the tree is a group of equal texts: the coordinates are those of its first document, so only a cut that
falls on the group itself divides it. Each node is cut across its widest dimension where the bytes on either side are
in proportion to the shards they will become. The cuts of one level are searched together: a histogram of bytes over
the keys of each node, refined inside the bin that holds the cut. No step sorts a node or gathers its rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import hash62, running_total, staged

SHARDS = 16
#: Bins of one histogram; the driver sees this many sums per node and level, whatever the number of documents.
BINS = 4096
#: A cut is close enough when its bin holds less than this part of the bytes of the node.
CLOSE = 2e-5
_UNIT = (1 << 31) - 1
DIMENSIONS = ("d0", "d1", "d2", "d3")


def _coordinates(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, d0 … d3, th, rh): sizes, coordinates from 0 to 2^31 - 1, hashes of text and row."""
    own = docs.select("doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("g"))
    held = staged(own)
    first = held.groupBy("g", "size").agg(F.min(F.struct("doc_id", "source", "lang")).alias("f"))
    spot = F.lit(float(_UNIT))
    seen = first.agg(F.min("f.doc_id").alias("a"), F.max("f.doc_id").alias("b"), F.max("size").alias("s")).first()
    span = max(1, (seen.b or 0) - (seen.a or 0))
    named = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(hash62(c).bitwiseAND(F.lit(_UNIT)))
    points = first.select(
        F.col("g").alias("_g"), F.col("size").alias("_s"), named("f.source").alias("d0"), named("f.lang").alias("d1"),
        F.floor(F.log("size") / F.lit(max(1e-9, math.log(seen.s or 1))) * spot).cast("long").alias("d2"),
        F.floor((F.coalesce("f.doc_id", F.lit(seen.a or 0)) - F.lit(seen.a or 0)) / F.lit(float(span)) * spot).cast("long").alias("d3"))
    joined = held.join(points, (F.col("g") == F.col("_g")) & (F.col("size") == F.col("_s")))
    return staged(joined.select("doc_id", "size", "text_crc32", *DIMENSIONS, hash62("g").bitwiseAND(F.lit(_UNIT)).alias("th"), hash62("doc_id", "g").alias("rh")))


def _pick(values: list, index) -> "F.Column":
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _search(rows: DataFrame, key, nodes: list[int], low: list[int], width: list[int], base: list[int], want: list[float], close: list[float]) -> tuple[list[int], list[int], list[int]]:
    """For each node the bin of ``key`` that holds the ``want``-ed byte: its first key, its width, the bytes before it.

    Stops when the bin of every node is one key wide, or holds so few bytes that cutting at its border is close enough.
    """
    low, width, base, weight = list(low), list(width), list(base), [math.inf] * len(low)
    while any(w > 1 and weight[i] > close[i] for i, w in enumerate(width)):
        step = [max(1, -(-w // BINS)) for w in width]
        held = rows.select("node", (key - _pick(low, F.col("node"))).alias("off"), "size").where((F.col("off") >= 0) & (F.col("off") < _pick(width, F.col("node"))))
        binned = held.groupBy("node", F.floor(F.col("off") / _pick(step, F.col("node"))).alias("bin")).agg(F.sum("size").alias("size"))
        sums = {n: np.zeros(BINS + 1, np.int64) for n in nodes}
        for r in binned.collect():
            sums[r.node][r.bin] = r.size
        for n in nodes:
            before = base[n] + np.concatenate([[0], np.cumsum(sums[n])])
            # The last bin whose start lies below the wanted byte.
            at = int(np.clip(np.searchsorted(before, want[n], "left") - 1, 0, max(0, -(-width[n] // step[n]) - 1)))
            base[n], weight[n] = int(before[at]), int(sums[n][at])
            low[n], width[n] = low[n] + at * step[n], min(step[n], width[n] - at * step[n])
    return low, width, base, weight


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs``; the bytes of the shards are near equal.

    ``size`` is the UTF-8 bytes of the text plus one. Null texts count as empty; null sources, languages and ids have a
    place of their own at the edge of their dimension. Repeated rows are cut like any others, and share every key: they
    stay together. Other columns are ignored. An empty table gives no rows.
    """
    rows = _coordinates(docs)
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # A node is the first shard of a run of shards.
    runs = {0: shards}
    current = rows.withColumn("node", F.lit(0))
    while count and any(n > 1 for n in runs.values()):
        size = max(runs) + 1
        open_nodes = [n for n, k in runs.items() if k > 1]
        stats = {r.node: r for r in current.groupBy("node").agg(F.sum("size").alias("size"), *[f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()}
        axis, low, width, want, close = [0] * size, [0] * size, [1] * size, [0.0] * size, [0.0] * size
        for n in open_nodes:
            if n in stats:
                spans = [stats[n][f"{d}_max"] - stats[n][f"{d}_min"] for d in DIMENSIONS]
                axis[n] = int(np.argmax(spans))
                low[n], width[n] = stats[n][f"{DIMENSIONS[axis[n]]}_min"] << 31, (spans[axis[n]] + 1) << 31
                want[n], close[n] = stats[n].size * (runs[n] // 2) / runs[n], stats[n].size * CLOSE
        live = [n for n in open_nodes if n in stats]
        inside = current.where(F.col("node").isin(live)) if len(live) < len(stats) else current
        first = F.shiftleft(F.get(F.array(*DIMENSIONS), _pick(axis, F.col("node"))), 31) + F.col("th")
        low, width, base, weight = _search(inside, first, live, low, width, [0] * size, want, close)
        # A single point that holds more than the allowed rest is cut inside, in the order of its rows' hashes.
        tied = [n for n in live if weight[n] > close[n]]
        row_low, row_width, row_base, row_weight = [0] * size, [1 << 62 if n in tied else 1 for n in range(size)], base, [0] * size
        if tied:
            on_point = inside.where(F.col("node").isin(tied) & (first == _pick(low, F.col("node"))))
            row_low, row_width, row_base, row_weight = _search(on_point, F.col("rh"), tied, row_low, row_width, base, want, close)
        cuts_key, cuts_row, halves = [1 << 62] * size, [0] * size, [0] * size
        for n in live:
            halves[n] = runs[n] // 2
            start, has = (row_base, row_weight) if n in tied else (base, weight)
            # Cut before or after the bin, whichever is nearer.
            after = start[n] + has[n] - want[n] <= want[n] - start[n]
            if n in tied:
                cuts_key[n], cuts_row[n] = low[n], row_low[n] + (row_width[n] if after else 0)
            else:
                cuts_key[n], cuts_row[n] = low[n] + (width[n] if after else 0), 0
        cut, row_cut = _pick(cuts_key, F.col("node")), _pick(cuts_row, F.col("node"))
        right = (first > cut) | ((first == cut) & (F.col("rh") >= row_cut))
        current = staged(current.withColumn("node", F.when(right, F.col("node") + _pick(halves, F.col("node"))).otherwise(F.col("node"))))
        runs = {m: k for n, k0 in runs.items() for m, k in ([(n, k0 // 2), (n + k0 // 2, k0 - k0 // 2)] if k0 > 1 else [(n, k0)])}
    placed = running_total(current, ["node"], "rh", F.lit(1).cast("long"), count, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
