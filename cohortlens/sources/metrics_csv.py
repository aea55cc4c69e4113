"""Reading metric tables with unlike headers back to one summary per table.

A run writes its metrics as a small CSV file, but not every writer uses the same columns: threshold sweeps with one row per
threshold, lists of names and values, or one wide row. All files are read in one scan, each by its own header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalars

# Canonical metric names and the spellings accepted for each.
SPELLINGS = {
    "AUPRC": ("auprc", "averageprecision", "ap",),
    "bestdice": ("bestdice", "maxdice", "dicebest",),
    "bestthr": ("bestthr", "bestthreshold",),
    "bestsen": ("bestsen", "bestsensitivity", "sensitivity", "sen",),
    "bestpre": ("bestpre", "bestprecision", "precision", "pre",),
    "yendice": ("yen", "yendice", "diceyen", "yun", "yundice", "diceyun",),
    "yenthr": ("yenthr", "yenthreshold", "yunthr", "yunthreshold",),
    "yensen": ("yensen", "yensensitivity", "yunsen", "yunsensitivity",),
    "yenpre": ("yenpre", "yenprecision", "yunpre", "yunprecision",),
    "otsudice": ("otsu", "otsudice", "diceotsu",),
    "otsuthr": ("otsuthr", "otsuthreshold",),
    "otsusen": ("otsusen", "otsusensitivity",),
    "otsupre": ("otsupre", "otsuprecision",),
}
# Endings that name the threshold, sensitivity and precision beside a base metric.
ENDINGS = {"thr": ("thr", "threshold"), "sen": ("sen", "sensitivity"), "pre": ("pre", "precision")}
# Names that are no threshold method.
RESERVED = ("specificity", "threshold", "thresholdmethod", "sourcecsv", "warning")
# Spellings of the columns that hold a row's name, value, threshold and rates, first choice first.
KEY, VALUE = ("metric", "name", "key", "thr", "threshold"), ("value", "score", "metricvalue", "dice")
THRESHOLD, DICE = ("threshold", "thr"), ("dice", "bestdice")
SENSITIVITY, PRECISION = ("sensitivity", "sen", "bestsen"), ("precision", "pre", "bestpre")
ADAPTIVE = ("dice", "thr", "sen", "pre")
COLUMNS = ("AUPRC", "bestdice", "bestthr", "bestsen", "bestpre", *[f"{m}{part}" for m in ("yen", "otsu") for part in ADAPTIVE],
           "adaptive_method", "adaptive_dice", "adaptive_threshold", "adaptive_sensitivity", "adaptive_precision")

_RECORD = r"""(?=[^\r\n])[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+"""
_FIELD = r""",([^",]*+(?:"[^"]*+"[^",]*+)*+)"""
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def aliases() -> dict[str, str]:
    """Accepted spelling → canonical name."""
    return {spelling: name for name, spellings in SPELLINGS.items() for spelling in spellings}


def canonical(c) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def number(c: Column) -> Column:
    """A finite decimal number; anything else, infinities included, is none."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def metric_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """Rows of the CSV tables in ``text``, one whole table a row: the other columns, at, header, cells.

    ``at`` is the place of the row in its table; blank lines do not count. Quoted cells may hold commas, line breaks and
    doubled quotes. A null or empty text has no rows.
    """
    records = F.regexp_extract_all(F.regexp_replace(text, "^\ufeff", ""), F.lit(_RECORD), F.lit(0))

    def fields(record: Column) -> Column:
        cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))
        return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))

    others = [c for c in texts.columns if c != text]
    split = texts.select(*others, records.alias("_r"))
    rows = split.select(*others, F.get("_r", 0).alias("_h"), F.posexplode(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1)))).alias("at", "_line"))
    return rows.select(*others, "at", fields(F.col("_h")).alias("header"), fields(F.col("_line")).alias("cells"))


def read_metric_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``metric_rows`` of every file below ``path`` in one scan, with its partition columns and ``file``."""
    texts = spark.read.text(path, wholetext=True)
    return metric_rows(texts.withColumn("file", F.col("_metadata.file_path")))


def _cell(names: Sequence[str]) -> Column:
    """The cell below the first of the names that the header has (below the last such column, if it has several)."""
    found = None
    for name in names:
        place = (F.size("_names") - F.array_position(F.reverse("_names"), F.lit(name)) + 1).cast("int")
        here = F.array_contains("_names", name)
        found = F.when(here, F.try_element_at("cells", place)) if found is None else found.when(here, F.try_element_at("cells", place))
    return found


def summarize(rows: DataFrame, run: Sequence[str]) -> DataFrame:
    """One summary row per run (``COLUMNS``) from rows of metric tables (run, at, header, cells).

    A row whose name or threshold cell is a number belongs to the sweep; the first row with the best Dice gives what no
    named row gives, and its rates come before named ones. Of other rows, a known name with a value counts; without one,
    every cell below a known header counts. The first appearance of a metric wins. Without Otsu or Yen results, the first
    unknown name with a sibling ``<name>thr`` or ``<name>threshold`` is the adaptive method. A run is one table; tables without rows are left out.
    """
    run = list(run)
    known = aliases()
    named_columns = rows.withColumn("_names", F.transform("header", canonical))
    has_key = F.arrays_overlap("_names", F.array(*[F.lit(n) for n in KEY]))
    key = F.regexp_replace(F.when(has_key, _cell(KEY)).otherwise(F.get("cells", 0)), r"^\s+|\s+$", "")
    parsed = named_columns.select(*run, "at", "_names", "cells", key.alias("_key"), number(_cell(VALUE)).alias("_v"), number(_cell(THRESHOLD)).alias("_t2"),
                                  *[number(_cell(c)).alias(n) for n, c in (("_dice", DICE), ("_sen", SENSITIVITY), ("_pre", PRECISION))])
    parsed = parsed.withColumns({"_t": F.coalesce(number(F.col("_key")), "_t2"), "_k": canonical(F.col("_key"))}).withColumn("_name", scalars.lookup(known, F.col("_k")))

    place = F.struct(F.coalesce("_dice", "_v").alias("d"), (-F.col("at")).alias("at"))
    sweep = F.col("_t").isNotNull() & F.coalesce("_dice", "_v").isNotNull()
    best = parsed.where(sweep).groupBy(*run).agg(F.max(F.struct(place.alias("place"), F.col("_t").alias("thr"), F.col("_sen").alias("sen"), F.col("_pre").alias("pre"))).alias("_best"))

    wide = F.zip_with("_names", "cells", lambda n, c: F.struct(scalars.lookup(known, n).alias("name"), number(c).alias("v")))
    single = F.array(F.struct(F.col("_name").alias("name"), F.col("_v").alias("v")))
    metrics = parsed.where("_t IS NULL").select(*run, "at", F.posexplode(F.when(F.col("_name").isNotNull() & F.col("_v").isNotNull(), single).otherwise(wide)).alias("_col", "_m"))
    metrics = metrics.where("_m.name IS NOT NULL AND _m.v IS NOT NULL")
    names = sorted(set(known.values()))
    firsts = metrics.groupBy(*run).agg(*[F.min(F.when(F.col("_m.name") == n, F.struct("at", "_col", "_m.v"))).getField("v").alias(n) for n in names])

    values = parsed.where((F.col("_k") != "") & F.col("_v").isNotNull()).groupBy(*run, "_k").agg(
        F.min(F.struct("at", F.lower("_key").alias("method"), F.col("_v").alias("v"))).alias("_i"), F.first("_name").alias("_name"))
    base = values.where(F.col("_name").isNull() & ~F.col("_k").startswith("auprc") & ~F.col("_k").isin(*RESERVED))
    siblings = [F.struct(F.lit(part).alias("part"), F.lit(i).alias("choice"), F.concat("_k", F.lit(end)).alias("k")) for part, ends in ENDINGS.items() for i, end in enumerate(ends)]
    wanted = base.select(*run, F.col("_k").alias("_base"), F.col("_i").alias("_b"), F.explode(F.array(*siblings)).alias("_s"))
    wanted = wanted.select(*run, "_base", "_b", "_s.part", "_s.choice", F.col("_s.k").alias("_k"))
    found = wanted.join(values.select(*run, "_k", F.col("_i.v").alias("_sv")), [*run, "_k"]).groupBy(*run, "_base").agg(
        F.first("_b").alias("_b"), *[F.min(F.when(F.col("part") == part, F.struct("choice", "_sv"))).getField("_sv").alias(f"_g{part}") for part in ENDINGS])
    generic = found.where("_gthr IS NOT NULL").groupBy(*run).agg(F.min(F.struct(F.col("_b.at").alias("at"), F.col("_b.method").alias("method"), F.col("_b.v").alias("dice"),
                                                                               F.col("_gthr").alias("thr"), F.col("_gsen").alias("sen"), F.col("_gpre").alias("pre"))).alias("_g"))

    out = parsed.select(*run).distinct().join(firsts, run, "left").join(best, run, "left").join(generic, run, "left")
    any_of = {m: F.coalesce(*[F.col(f"{m}{part}") for part in ADAPTIVE]).isNotNull() for m in ("otsu", "yen")}

    def adaptive(part: str) -> Column:
        return F.when(any_of["otsu"], F.col(f"otsu{part}")).when(any_of["yen"], F.col(f"yen{part}")).otherwise(F.col(f"_g.{part}"))

    ready = {
        "bestdice": F.coalesce("bestdice", "_best.place.d"), "bestthr": F.coalesce("bestthr", "_best.thr"),
        "bestsen": F.coalesce("_best.sen", "bestsen"), "bestpre": F.coalesce("_best.pre", "bestpre"),
        "adaptive_method": F.when(any_of["otsu"], "otsu").when(any_of["yen"], "yen").otherwise(F.col("_g.method")),
        "adaptive_dice": adaptive("dice"), "adaptive_threshold": adaptive("thr"), "adaptive_sensitivity": adaptive("sen"), "adaptive_precision": adaptive("pre"),
    }
    return out.select(*run, *[ready.get(c, F.col(c)).alias(c) for c in COLUMNS])


def two_versions(expected: DataFrame, summary: DataFrame, source: str) -> DataFrame:
    """The full summary of each expected table (any columns and ``source``): metrics of the table of that name, or a warning.

    ``expected`` lists a study's tables, for example two rows (raw, median_filter) per run; a null source is a table that was
    never written, and one without a summary a table that is missing or has no rows.
    """
    joined = expected.join(summary.withColumn("_found", F.lit(True)), source, "left")
    warning = F.when(F.col(source).isNull(), "metrics table not available").when(F.col("_found").isNull(), F.concat(F.lit("metrics table not found: "), source))
    return joined.select(*expected.columns, *COLUMNS, warning.alias("warning"))
