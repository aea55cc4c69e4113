"""Checked joins and set operations (J2–J14, U1–U8). Every check returns its findings as a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators.scale import attach


class AuditError(ValueError):
    """A fail-closed check found violations."""


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_empty(findings: DataFrame, message: str, preview: int = 10) -> None:
    """Stop with the first findings; only the preview reaches the driver."""
    rows = findings.take(preview)
    if rows:
        raise AuditError(f"{message}: " + ", ".join(str(r.asDict()) for r in rows))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AuditError(f"missing columns: {', '.join(missing)}")
    return df


def tagged(rule: str, df: DataFrame, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def slices_against_sessions(slices: DataFrame, sessions: DataFrame, case: str = "case_id", z: str = "z") -> DataFrame:
    """(rule, key): slices of cases that are not PASS, PASS cases without slices, repeated (case, z)."""
    passed = sessions.where("status = 'PASS'").select(case).distinct()
    cases = slices.select(case).distinct()
    return union([
        tagged("case_not_pass", cases.join(passed, case, "left_anti"), F.col(case)),
        tagged("pass_without_slices", passed.join(cases, case, "left_anti"), F.col(case)),
        tagged("duplicate_slice", duplicates(slices, [case, z]), F.concat_ws(":", case, z)),
    ])


def manifest_against_predictions(manifest: DataFrame, predictions: DataFrame, index: str, identity: Sequence[str], label: str, probability: str) -> DataFrame:
    """(record_index, problems) for every row that is missing, differs in identity or label, or has no probability."""
    m = manifest.select(index, *[F.col(c).alias(f"_m_{c}") for c in (*identity, label)], F.lit(True).alias("_m"))
    p = predictions.select(index, *[F.col(c).alias(f"_p_{c}") for c in (*identity, label)], F.col(probability).alias("_prob"), F.lit(True).alias("_p"))
    both = m.join(p, index, "full_outer")
    found = F.col("_m").isNotNull() & F.col("_p").isNotNull()
    checks = [
        F.when(F.col("_m").isNull(), "not_in_manifest"),
        F.when(F.col("_p").isNull(), "no_prediction"),
        *[F.when(found & ~F.col(f"_m_{c}").eqNullSafe(F.col(f"_p_{c}")), f"{c}_differs") for c in (*identity, label)],
        F.when(found & ~F.coalesce(scalars.is_finite("_prob") & F.col("_prob").between(0, 1), F.lit(False)), "bad_probability"),
    ]
    problems = F.array_compact(F.array(*checks))
    return both.select(index, problems.alias("problems")).where(F.size("problems") > 0)


def keyed_join(rows: DataFrame, source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Join rows to a source that must be unique on the key; second result: repeated source keys."""
    return rows.join(source, list(keys), "left"), duplicates(source, keys)


def fallback_join(rows: DataFrame, lookups: Sequence[tuple[Sequence[str], DataFrame]], value: str) -> DataFrame:
    """First value found by a prioritized list of keys, with the number of the key that matched.

    A lookup key naming several values is a conflict: it gives NULL and the flag ``conflict``.
    """
    out = rows
    for i, (keys, lookup) in enumerate(lookups):
        one = lookup.groupBy(*keys).agg(
            F.when(F.min(value) == F.max(value), F.min(value)).alias(f"_v{i}"), (F.min(value) != F.max(value)).alias(f"_c{i}")
        )
        out = attach(out, one, keys, "left")
    n = len(lookups)
    matched = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)) for i in range(n)])
    conflict = reduce(lambda a, b: a | b, [F.coalesce(f"_c{i}", F.lit(False)) for i in range(n)])
    return out.select(
        *rows.columns, F.coalesce(*[f"_v{i}" for i in range(n)]).alias(value), matched.alias("matched_by"), conflict.alias("conflict")
    )


def against_ledger(rows: DataFrame, ledger: DataFrame, identity: Sequence[str], digest: str, members: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(identity, problem) for rows whose digest is missing or different, or that are outside the scoped membership."""
    expected = ledger.select(*identity, F.col(digest).alias("_want"))
    inside = members.select(*scope).distinct().withColumn("_in", F.lit(True))
    both = attach(rows.join(expected, list(identity), "left"), inside, scope, "left")
    problem = (
        F.when(F.col("_want").isNull(), "not_in_ledger")
        .when(F.col("_want") != F.col(digest), "digest_differs")
        .when(F.col("_in").isNull(), "outside_scope")
    )
    return both.select(*dict.fromkeys([*identity, *scope]), problem.alias("problem")).where("problem IS NOT NULL")


def one_per_key(left: DataFrame, right: DataFrame, key: str, expected: Sequence) -> DataFrame:
    """Join two result tables that must hold exactly one row for every expected key; anything else stops the job."""
    listed = F.array(*[F.lit(e) for e in expected])

    def once(df: DataFrame) -> DataFrame:
        values = [F.first(c).alias(c) for c in df.columns if c != key]
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *values).withColumn(
            key, scalars.fail_unless((F.col("_n") == 1) & F.array_contains(listed, F.col(key)), F.col(key), "a key is repeated or unexpected")
        ).drop("_n")

    return once(left).join(once(right), key)


def compare_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tie: float = 1e-12) -> DataFrame:
    """A against B per key: difference, relative percentage and winner; a key on one side only stops the job."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    gap = F.col("b") - F.col("a")
    winner = F.when(F.abs(gap) <= tie, "tie").when(gap > 0, "b").otherwise("a")
    return both.withColumns({
        "difference": gap,
        "relative_percent": F.when(F.col("a") != 0, 100.0 * gap / F.abs(F.col("a"))),
        "winner": scalars.fail_unless(paired, winner, "the two versions report different metrics"),
    })


def one_to_many(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join where the left side must be unique: its repeated keys stop the job."""
    once = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in left.columns if c not in keys])
    first = once.columns[-1]
    checked = once.withColumn(first, scalars.fail_unless(F.col("_n") == 1, F.col(first), "left keys of a one-to-many join repeat")).drop("_n")
    return attach(right, checked, keys)


def against_baseline(df: DataFrame, key: Sequence[str], variant: str, baseline: str, values: Sequence[str]) -> DataFrame:
    """Change of each value from the baseline variant of the same key."""
    base = df.where(F.col(variant) == baseline).select(*key, *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = df.join(base, list(key), "left")
    return joined.select(*df.columns, *[(F.col(v) - F.col(f"_b_{v}")).alias(f"delta_{v}") for v in values])


def intersect_sources(first: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first source whose key is in every other source, in the first source's order column."""
    return reduce(lambda acc, o: acc.join(o.select(key).distinct(), key, "left_semi"), others, first)


def union_cohorts(cohorts: dict[str, DataFrame], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Union with a source column, and the ids that occur in more than one place."""
    rows = union([df.withColumn("source", F.lit(name)) for name, df in cohorts.items()])
    clash = rows.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_set("source")).alias("sources")
    ).where("copies > 1")
    return rows, clash


def split_overlap(df: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """Ids per pair of splits that share them. A participant has at most one entry per split."""
    per = df.groupBy(id_col).agg(F.array_sort(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
    pairs = per.select(id_col, F.explode(F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("_p"))
    return pairs.groupBy(F.col("_p.a").alias("left_split"), F.col("_p.b").alias("right_split")).agg(F.count(F.lit(1)).alias("shared"))


def multiset_difference(expected: DataFrame, observed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, side, copies): rows missing from or extra in the observed table, counting multiplicity.

    One signed count per distinct row: the same as EXCEPT ALL both ways, in a single shuffle with a map-side combine.
    """
    a = expected.select(*columns, F.lit(1).alias("_d"))
    b = observed.select(*columns, F.lit(-1).alias("_d"))
    net = a.unionByName(b).groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return net.select(*columns, F.when(F.col("_d") > 0, "missing").otherwise("extra").alias("side"), F.abs(F.col("_d")).alias("copies"))


def field_mismatches(expected: DataFrame, observed: DataFrame, identity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, mismatches): rows of equal identity whose field differs."""
    a = expected.select(*identity, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = observed.select(*identity, *[F.col(f).alias(f"_b_{f}") for f in fields])
    counts = a.join(b, list(identity)).agg(*[F.count_if(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))).alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "mismatches")


def symmetric_difference(configured: DataFrame, adjudicated: DataFrame, key: str) -> DataFrame:
    a, b = configured.select(key).distinct(), adjudicated.select(key).distinct()
    return union([
        a.join(b, key, "left_anti").withColumn("side", F.lit("configured_only")),
        b.join(a, key, "left_anti").withColumn("side", F.lit("adjudicated_only")),
    ])


def plan_coverage(plan: DataFrame, observed: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Every planned or observed cell with its number of results and status."""
    counts = observed.groupBy(*cell).agg(F.count(F.lit(1)).alias("results"))
    both = plan.select(*cell, F.lit(True).alias("_p")).join(counts, list(cell), "full_outer")
    status = (
        F.when(F.col("_p").isNull(), "unplanned").when(F.col("results").isNull(), "missing")
        .when(F.col("results") > 1, "duplicate").otherwise("complete")
    )
    return both.select(*cell, F.coalesce("results", F.lit(0)).alias("results"), status.alias("status"))


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    return rows.join(drop.select(key).distinct(), key, "left_anti")
