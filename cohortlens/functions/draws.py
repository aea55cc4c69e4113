"""Seeded draws by hashing.

A uniform draw is a function of (seed, id) and of nothing else: it does not depend on partitioning, retries or row
order, and any SQL engine with md5 reproduces it. The law is that of a seeded generator over sorted ids (uniform, without
replacement); the individual draws differ from a sequential generator's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.scale import BAND, ordinals, parallelism


def hash_text(seed: int | str | Column, *parts: Column | str) -> Column:
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", first.cast("string"), *[c.cast("string") for c in cols]))


def hash_long(digest: Column) -> Column:
    """First 60 bits of a digest as a BIGINT."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_unit(seed, *parts) -> Column:
    """Uniform number in [0, 1): 52 bits, which a double holds exactly."""
    return F.conv(F.substring(hash_text(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def hash_index(n: Column | int, seed, *parts) -> Column:
    """Uniform index in 0 … n-1 (bias below n / 2^60)."""
    size = n if isinstance(n, Column) else F.lit(n)
    return hash_long(hash_text(seed, *parts)) % size


def hash_bit(seed, *parts) -> Column:
    return hash_long(hash_text(seed, *parts)) % 2


def permuted(df: DataFrame, id_col: str, seed: int | str | Column, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based position of each id in the seeded permutation, inside ``keys``. Ids are unique per key.

    Hashes are uniform, so equal-width hash bands are balanced for any key distribution and no key sits in one task.
    """
    bands = parallelism(df.sparkSession)
    hashed = df.withColumn("_h", hash_text(seed, id_col)).withColumn(
        BAND, F.shiftright(F.shiftright(hash_long(F.col("_h")), 30) * F.lit(bands), 30).cast("int")
    )
    return ordinals(hashed, keys, ["_h", id_col], out).drop("_h")



# MD5 (RFC 1321) of messages of one block, many at a time: a call for each of the study's draws costs more than all the rest.
_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_ROOM, _AT_ONCE = 55, 8192


def _first_bits(words: np.ndarray) -> np.ndarray:
    """The first 60 bits of the digest of each column of ``words``, 16 little-endian words of a padded message."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    first = a.copy(), b.copy()
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += _SINES[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i])))
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b), first))
    return ((high << np.uint64(28)) | (low >> np.uint64(4))).astype(np.int64)


def hash_grid(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """``hash_long`` of the MD5 of every head followed by every tail: a row for each head, a column for each tail."""
    out = np.empty((len(heads), len(tails)), np.int64)
    length = np.array([len(t) for t in tails], np.int64)
    longest = max(map(len, heads), default=0)
    short = np.flatnonzero(length + longest <= _ROOM)
    for j in np.flatnonzero(length + longest > _ROOM):
        out[:, j] = [int(hashlib.md5(h + tails[j]).hexdigest()[:15], 16) for h in heads]
    # The bit that ends a message follows its last byte.
    ended = np.array([tails[j] + b"\x80" for j in short], "S")
    for size in sorted({len(h) for h in heads}):
        of = np.array([i for i, h in enumerate(heads) if len(h) == size])
        front = np.array([list(heads[i]) for i in of], np.uint8).reshape(len(of), size)
        for j in range(0, len(short), _AT_ONCE):
            part = ended[j:j + _AT_ONCE]
            width, step = part.dtype.itemsize, max(1, _AT_ONCE // len(part))
            bits = ((size + length[short[j:j + _AT_ONCE]]) * 8).astype("<u4").view(np.uint8).reshape(-1, 4)
            for i in range(0, len(of), step):
                text = np.zeros((len(of[i:i + step]), len(part), 64), np.uint8)
                text[:, :, :size] = front[i:i + step, None]
                text[:, :, size:size + width] = part.view(np.uint8).reshape(-1, width)
                text[:, :, 56:60] = bits
                words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)
                out[np.ix_(of[i:i + step], short[j:j + _AT_ONCE])] = _first_bits(words).reshape(-1, len(part))
    return out
