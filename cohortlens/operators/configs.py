"""Nested configurations as rows of paths, and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def nesting(document: str) -> Column:
    """How deep the objects of a JSON text are nested; braces inside strings do not count."""
    braces = F.regexp_replace(F.regexp_replace(document, _STRINGS, ""), "[^{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s.now + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s.most, now).alias("most"))

    return F.aggregate(F.split(braces, ""), start, step).most


def config_paths(configs: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """(keys, field, value): every leaf of a JSON document with its dotted path; values are JSON texts.

    Objects are opened level by level down to the deepest document. Lists and nulls are leaves, an empty object has none, a
    document that is no object is one leaf without a path (null). A null document has no rows; malformed JSON stops the job.
    """
    keys, spark = list(keys), configs.sparkSession
    deepest = configs.agg(F.max(nesting(document))).first()[0] or 0
    level = configs.where(F.col(document).isNotNull()).select(*keys, F.lit(None).cast("string").alias("field"), F.parse_json(document).alias("_v"))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    out = level.where(~is_object)
    for _ in range(deepest):
        opened = level.where(is_object).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = opened.select(*keys, F.concat_ws(".", "field", "key").alias("field"), F.col("value").alias("_v"))
        out = out.unionByName(level.where(~is_object))
    return out.select(*keys, "field", F.to_json("_v").alias("value"))


def config_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """Paths whose values differ: (keys, field, a, b). A side without the path is null, a JSON null is the text ``null``."""
    names = [*keys, "field"]
    left = config_paths(a, keys, document).withColumnRenamed("value", "a")
    right = config_paths(b, keys, document).select(*[F.col(c).alias(f"_{c}") for c in names], F.col("value").alias("b"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = left.join(right, same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) for c in names], "a", "b")
