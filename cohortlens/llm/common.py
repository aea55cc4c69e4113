"""Small shared pieces: staged tables, running totals that no hot key can overload, connected components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.scale import staged

__all__ = ["bit_table", "components", "free_name", "hash62", "in_table", "read_table", "row_key", "running_total", "staged"]

# Rows that one task ranks at a time in ``running_total``.
ROWS_PER_BUCKET = 10_000
#: Bits of a table of hashes: 2 to the power of these, 8 MB at most.
FEWEST, MOST = 16, 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash62(*columns: Column | str) -> Column:
    """A non-negative 62-bit hash, so that sums and shifts of it stay inside a long."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's values, equal for repeats only (128 bits); columns of maps, which have no hash, are left out."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    # A hash passes over nulls: where they stand is part of the key.
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), nulls, *columns)


def _has_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def bit_table(hashes: DataFrame, name: str, most: int = MOST) -> tuple[int, np.ndarray]:
    """The 64-bit hashes in column ``name`` as bits, for a look before a shuffle.

    Its size is bounded whatever their number: where it fills up it only lets more through, so an exact join must follow.
    """
    power = min(most, max(min(FEWEST, most), (32 * hashes.count()).bit_length()))
    spots = hashes.select(F.shiftrightunsigned(name, 64 - power).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return power, bits.view(np.uint64)


def in_table(hashes: np.ndarray, table: tuple[int, np.ndarray]) -> np.ndarray:
    """Which of the hashes (unsigned) may be in the table."""
    power, bits = table
    at = hashes >> np.uint64(64 - power)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def running_total(df: DataFrame, keys: Sequence[str], order: str, weight: Column, rows: int, out: str = "before") -> DataFrame:
    """Add the exclusive running sum of ``weight`` inside ``keys`` in ascending ``order`` (a 62-bit hash).

    The hash range is cut into buckets of about ``ROWS_PER_BUCKET`` rows, ranked each on its own and shifted by the sums
    of the earlier buckets, so a key with a third of all rows is spread like any other. Rows with the same keys and
    order are taken one after the other; where they are exact repeats the result is the same in any order.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    step = -(-(1 << 62) // buckets)
    # Integer division: the bucket grows with the hash.
    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(step)).cast("int") if buckets > 1 else F.lit(0)).withColumn("_w", weight)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_s"))
    shifts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_shift"))
    ranked = cut.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    match = F.col("_bucket") == F.col("_b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranked.join(shifts, match).withColumn(out, F.col("_in") + F.col("_shift")).drop("_bucket", "_b", "_w", "_in", "_shift", *[f"_k_{k}" for k in keys])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v of one orderable type): rows (node, root), root the smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014) until the edges are stars. Each round is written to the
    checkpoint folder, so a lost executor costs no more than that round. Nodes without an edge are not listed.
    """
    current = staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while True:
        # Stars: every node is either a centre or hangs on exactly one.
        leaves = current.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if leaves.where("n > 1").isEmpty() and current.join(leaves.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour of u meets the smallest node that u knows.
        large = both.where("v > u").join(lowest, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: every smaller neighbour of v, and v itself, meets the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        current = staged(small)
    roots = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
