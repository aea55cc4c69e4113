"""Row, set and tensor digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.scale import banded, ordinals


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with the fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def set_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest of a row set: row count and sum of 60-bit row hashes.

    Sums keep duplicate rows apart (an exclusive or would cancel them) and combine map-side.
    """
    h = F.conv(F.substring(F.md5(canonical_json(columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"))


def ordered_digest(df: DataFrame, group: Sequence[str], key: str, columns: Sequence[str]) -> DataFrame:
    """Digest of the rows of each group in ``key`` order: the sum of hashes of (position, row hash).

    Positions come from banded ranks and the sum combines map-side, so no group is ever gathered.
    """
    hashed = df.select(*group, key, fingerprint(columns).alias("_h"))
    placed = ordinals(banded(hashed, key), group, [key, "_h"], "_pos")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "_pos", "_h")), 1, 15), 16, 10).cast("decimal(38,0)")
    return placed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"))


def tensor_digest(px: Column | str) -> Column:
    """Digest of an array of floats by its values, rounded to nine decimals to be engine-independent."""
    col = F.col(px) if isinstance(px, str) else px
    text = F.array_join(F.transform(col, lambda v: F.round(v.cast("double") * 1e9).cast("long").cast("string")), ",")
    return F.sha2(text, 256)


def ledger(df: DataFrame, identity: Sequence[str], px: str) -> DataFrame:
    """(identity, copies, digest, consistent): rows that share an identity must share a digest."""
    hashed = df.select(*identity, tensor_digest(px).alias("_h"))
    return hashed.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("copies"), F.min("_h").alias("digest"), (F.min("_h") == F.max("_h")).alias("consistent")
    )
