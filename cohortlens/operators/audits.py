"""Fail-closed audits and quality control (N1–N20). An audit returns the violations it found; an empty table is PASS."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import normalize
from cohortlens.operators.scale import attach, banded, exact_quantiles, ordinals, running, staged
from cohortlens.operators.sets import duplicates, tagged, union


def failing(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold (NULL counts as a failure)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def rule_violations(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, key) in one pass over the rows, whatever the number of rules."""
    return df.select(F.explode(failing(rules)).alias("rule"), key.cast("string").alias("key"))


def record_audit(records: DataFrame, bins: int = 20) -> DataFrame:
    """Duplicates, split disjointness, identity, position and tumor-free rules of the manifest."""
    norm, z = F.col("z_norm"), F.col("z_bin")
    rules = {
        "identity_missing": F.col("participant").isNotNull() & F.col("case_id").isNotNull() & (F.col("record_id") != ""),
        "z_out_of_range": norm.between(0.0, 1.0) & z.between(0, bins - 1),
        "z_bin_mismatch": z == scalars.z_bin(norm, bins),
        "unknown_split": F.col("split").isin("train", "val", "test"),
    }
    if "mask_voxels" in records.columns:
        rules["lesion_voxels"] = F.coalesce(F.col("mask_voxels") == 0, F.lit(True))
    splits = records.groupBy("participant").agg(F.countDistinct("split").alias("n")).where("n > 1")
    return union([
        rule_violations(records, F.col("record_id"), rules),
        tagged("duplicate_record", duplicates(records, ["record_id"]), F.col("record_id")),
        tagged("participant_in_several_splits", splits, F.col("participant")),
    ])


def pair_audit(records: DataFrame, cap: int = 2) -> DataFrame:
    """Both labels, equal z histograms, cap per bin, one participant per label, one split, one pair per participant."""
    per_bin = records.groupBy("pair_id", "z_bin").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )
    hist = per_bin.groupBy("pair_id").agg(
        F.bool_and(F.col("n0") == F.col("n1")).alias("equal"), F.max(F.greatest("n0", "n1")).alias("top"),
        F.sum("n0").alias("s0"), F.sum("n1").alias("s1"),
    )
    people = records.groupBy("pair_id", "label", "participant", "split").agg(F.count(F.lit(1)).alias("_n"))
    members = people.groupBy("pair_id").agg(
        F.countDistinct(F.when(F.col("label") == 0, F.col("participant"))).alias("p0"),
        F.countDistinct(F.when(F.col("label") == 1, F.col("participant"))).alias("p1"),
        F.countDistinct("split").alias("splits"),
    )
    both = hist.join(members, "pair_id")
    rules = {
        "labels": (F.col("s0") > 0) & (F.col("s1") > 0),
        "z_histogram_mismatch": F.col("equal"),
        "per_bin_cap": F.col("top") <= cap,
        "slice_count_mismatch": F.col("s0") == F.col("s1"),
        "participants_per_label": (F.col("p0") == 1) & (F.col("p1") == 1),
        "split_mismatch": F.col("splits") == 1,
    }
    repeated = people.groupBy("participant").agg(F.countDistinct("pair_id").alias("n")).where("n > 1")
    return union([
        rule_violations(both, F.col("pair_id"), rules),
        tagged("participant_in_several_pairs", repeated, F.col("participant")),
    ])


def counts_by(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, rows) for several columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return records.select(F.explode(cells).alias("_c")).groupBy("_c.dimension", "_c.value").agg(F.count(F.lit(1)).alias("rows"))


def expectations(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose count differs from the configured one, missing ones included."""
    a = actual.select(*keys, F.col(value).alias("actual"))
    e = expected.select(*keys, F.col(value).alias("expected"))
    both = a.join(e, list(keys), "full_outer")
    return both.withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))


def pair_summaries(records: DataFrame) -> DataFrame:
    """One row per pair of an audited table: its split (null if it has several), records, slices per domain, depth bins with
    their slices, participants. A pair has at most cap × bins rows per label, so its map and list are bounded."""
    per_bin = records.groupBy("pair_id", "z_bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n0"), F.collect_set("participant").alias("people"), F.min("split").alias("s0"), F.max("split").alias("s1"))
    return per_bin.groupBy("pair_id").agg(
        F.when(F.min("s0") == F.max("s1"), F.min("s0")).alias("split"), F.sum("n").alias("records"), F.sum("n0").alias("slices_per_domain"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n0") > 0, F.struct("z_bin", "n0"))))).alias("z_histogram"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("people")))).alias("participants"),
    )


def distinct_values(df: DataFrame, map_col: str, pattern: str) -> DataFrame:
    """(field, values, references): distinct values of the map entries whose key matches, counted in two steps."""
    return provenance(df, map_col, pattern).groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.sum("references").alias("references"))


def manifest_provenance(df: DataFrame, keys: Sequence[str], split: str, subject: str, session: str) -> DataFrame:
    """Rows, columns, rows per split, distinct subjects and sessions of a manifest. Distinct counts are made in two steps, so
    that the values of a hot key are spread. Rows without a split count under the empty name."""
    per = df.groupBy(*keys, subject, session, F.coalesce(split, F.lit("")).alias("_split")).agg(F.count(F.lit(1)).alias("_n"))
    people = per.groupBy(*keys, subject, session).agg(F.sum("_n").alias("_n")).groupBy(*keys, subject).agg(F.sum("_n").alias("_n"), F.count(session).alias("_c"))
    whole = people.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count(subject).alias("subjects"), F.sum("_c").alias("sessions"))
    splits = per.groupBy(*keys, "_split").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_split", "_n")))).alias("split_counts"))
    columns = F.array(*[F.lit(c) for c in df.columns]).alias("columns")
    return whole.join(splits, list(keys)).select(*keys, "rows", columns, "split_counts", "subjects", "sessions")


def provenance(df: DataFrame, map_col: str, pattern: str) -> DataFrame:
    """(field, value, references) over the entries of a map column whose key matches."""
    entries = df.select(F.explode(map_col).alias("field", "value")).where(F.col("field").rlike(pattern))
    return entries.groupBy("field", "value").agg(F.count(F.lit(1)).alias("references"))


# Limits of the automatic session check.
VOLUME_RANGE = (0.5, 2.5)
SINGULAR_RANGE = (0.25, 4.0)
MIN_MASK_DICE = 0.70
MIN_RETENTION = 0.98


def qc_status(df: DataFrame) -> DataFrame:
    """Adds ``flags`` and ``status``: hard rules FAIL, soft rules REVIEW, otherwise PASS."""
    number = scalars.is_finite

    def bad(ok: Column, flag: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(flag))

    checks = [bad(F.col(c), f"FAIL:{c}") for c in ("image_finite", "mask_finite", "geometry_valid", "shape_valid")]
    checks += [
        bad(number("brain_volume_L") & F.col("brain_volume_L").between(*VOLUME_RANGE), "FAIL:brain_volume_outside_0.5_2.5_L"),
        bad(number("det") & (F.col("det") > 0), "FAIL:nonpositive_or_nonfinite_determinant"),
        bad(number("sv_min") & number("sv_max") & (F.col("sv_min") >= SINGULAR_RANGE[0]) & (F.col("sv_max") <= SINGULAR_RANGE[1]),
            "FAIL:catastrophic_singular_value"),
        bad(number("mask_dice") & (F.col("mask_dice") >= MIN_MASK_DICE), "FAIL:mask_dice_below_0.70"),
    ]
    for name in ("T1_MNI_MI_improvement", "FLAIR_T1_MI_improvement", "T2_T1_MI_improvement"):
        checks.append(bad(number(name) & (F.col(name) > 0), f"REVIEW:{name}_nonpositive"))
    checks.append(bad(number("guard_retention") & (F.col("guard_retention") >= MIN_RETENTION), "REVIEW:guard_retention_below_0.98"))
    out = df.withColumn("flags", F.array_compact(F.array(*checks)))
    hard = F.exists("flags", lambda f: f.startswith("FAIL:"))
    return out.withColumn("status", F.when(hard, "FAIL").when(F.size("flags") > 0, "REVIEW").otherwise("PASS"))


# Consistency constant of the modified z-score, its alarm level and the stand-in for an infinite score.
MODIFIED_Z = 0.67448975
ALARM = 3.5
INFINITE_SCORE = 1e12


def modified_z(long: DataFrame) -> DataFrame:
    """(field, id, value, z): robust z per field from exact medians; MAD ≈ 0 gives 0 or ∞."""
    finite = long.where(scalars.is_finite("value"))
    medians = exact_quantiles(finite, ["field"], "value", {"_med": 0.5})
    # One row per field.
    centred = staged(attach(finite, medians, ["field"]).withColumn("_dev", F.abs(F.col("value") - F.col("_med"))))
    mads = exact_quantiles(centred, ["field"], "_dev", {"_mad": 0.5})
    ready = attach(centred, mads, ["field"])
    flat = F.when(F.col("_dev") <= 1e-12, 0.0).otherwise(F.lit(float("inf")))
    z = F.when(F.col("_mad") <= 1e-12, flat).otherwise(MODIFIED_Z * (F.col("value") - F.col("_med")) / F.col("_mad"))
    return ready.select("field", "id", "value", z.alias("z"))


def field_ranks(long: DataFrame, scored: DataFrame) -> DataFrame:
    """(field, id, magnitude, rank): 1-based rank by |z| descending, ties by id; a missing value ranks with 0."""
    sizes = long.select("field", "id").join(scored.select("field", "id", "z"), ["field", "id"], "left")
    magnitude = F.when(F.col("z").isNull(), 0.0).otherwise(F.least(F.abs(F.col("z")), F.lit(INFINITE_SCORE)))
    rows = staged(sizes.select("field", "id", "z", magnitude.alias("magnitude"), (-magnitude).alias("_neg")))
    # Equal magnitudes are counted first and numbered among themselves in bands of the id, so a field in which most
    # values tie is spread like any other.
    ties = staged(rows.groupBy("field", "_neg").agg(F.count(F.lit(1)).alias("n")))
    earlier = running(banded(ties, "_neg"), ["field"], ["_neg"], ["n"]).select("field", "_neg", "n_before")
    inside = ordinals(banded(rows, "id"), ["field", "_neg"], ["id"], "_r")
    ranked = attach(inside, earlier, ["field", "_neg"])
    return ranked.select("field", "id", "z", "magnitude", (F.col("n_before") + F.col("_r") + 1).alias("rank"))


def outliers(df: DataFrame, id_col: str, fields: Sequence[str], alarm: float = ALARM) -> DataFrame:
    """(id, outlier_score, worst_rank, outlier_flags) from the robust z of every field."""
    doubled = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in fields])
    long = staged(doubled.unpivot("id", list(fields), "field", "value"))
    ranks = field_ranks(long, modified_z(long))
    alarmed = scalars.is_finite("z") & (F.abs(F.col("z")) >= alarm)
    flag = F.when(alarmed, F.concat(F.lit("REVIEW:outlier_"), F.col("field"), F.lit("_modified_z="), F.format_number("z", 3)))
    # Flags per id: at most one per field.
    return ranks.groupBy("id").agg(
        F.max("magnitude").alias("outlier_score"), F.min("rank").alias("worst_rank"),
        F.array_sort(F.collect_list(flag)).alias("outlier_flags"),
    )


def most_suspicious(scored: DataFrame, count: int = 15) -> DataFrame:
    """The report's top list: best rank on any field, then the larger score. TakeOrderedAndProject, no full sort."""
    return scored.orderBy("worst_rank", F.desc("outlier_score"), "id").limit(count)


def merge_outlier_status(qc: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    joined = qc.join(scored.withColumnRenamed("id", id_col), id_col, "left")
    extra = F.coalesce("outlier_flags", F.array().cast("array<string>"))
    status = F.when((F.size(extra) > 0) & (F.col("status") == "PASS"), "REVIEW").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "flags": F.concat("flags", extra)}).drop("outlier_flags")


def release_gate(df: DataFrame, keys: Sequence[str], automatic: str, manual: str, allowed: str) -> DataFrame:
    """Release status per key. ``manual`` is NULL for sessions outside the review queue; ``allowed`` flags the
    configured exclusions. An automatic FAIL cannot be overridden; an exclusion that is not configured fails; a
    configured one that was not made, or any open decision, is pending."""
    auto, hand = F.col(automatic), F.col(manual)
    excluded = F.coalesce(hand == "EXCLUDE", F.lit(False))
    listed = F.coalesce(F.col(allowed), F.lit(False))
    failed = F.coalesce(auto == "FAIL", F.lit(False)) | F.coalesce(hand == "FAIL", F.lit(False)) | (excluded & ~listed)
    waiting = (listed & ~excluded) | F.coalesce(~hand.isin("PASS", "EXCLUDE"), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(failed).alias("failed"), F.count_if(waiting).alias("waiting"),
        F.when(F.bool_or(failed), "FAIL").when(F.bool_or(waiting), "PENDING_MANUAL_REVIEW").otherwise("PASS").alias("release"),
    )


def upsert_review_queue(queue: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """New queue with the decisions already taken; new rows start as PENDING."""
    old = earlier.select(key, F.col("decision").alias("_d"), F.col("note").alias("_n"))
    joined = queue.join(old, key, "left")
    return joined.withColumns({"decision": F.coalesce("_d", F.lit("PENDING")), "note": F.coalesce("_n", F.lit(""))}).drop("_d", "_n")


def adjudicate(queue: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Apply decisions to pending rows only; a decided row keeps its decision."""
    new = decisions.select(key, F.col("decision").alias("_d"))
    joined = queue.join(new, key, "left")
    decided = F.when(F.col("decision") == "PENDING", F.coalesce("_d", "decision")).otherwise(F.col("decision"))
    return joined.withColumn("decision", decided).drop("_d")


def store_audit(df: DataFrame, key: str, px: str, size: int) -> DataFrame:
    """One row: entries, contiguous keys, shape and finiteness of a slice store."""
    finite = F.forall(px, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.bool_and(F.size(px) == size).alias("shape"), F.bool_and(finite).alias("finite"))
    return keys.agg(
        F.sum("c").alias("entries"), F.count_if(F.col("c") > 1).alias("repeated_keys"),
        ((F.max(key) + 1 == F.count(F.lit(1))) & (F.min(key) == 0)).alias("contiguous"),
        F.bool_and("shape").alias("shape_ok"), F.bool_and("finite").alias("finite_ok"),
    )


def read_back(before: DataFrame, after: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Compare a written table with its source: same rows, same zero mask, positives stay positive, finite."""
    a = before.select(*keys, group, F.col(value).alias("_a"))
    b = after.select(*keys, F.col(value).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~present).alias("unmatched"),
        F.bool_and((F.col("_a") == 0) == (F.col("_b") == 0)).alias("zero_mask_same"),
        F.bool_and((F.col("_a") <= 0) | (F.col("_b") > 0)).alias("positives_kept"),
        F.bool_and(scalars.is_finite("_b")).alias("finite"),
        F.avg("_a").alias("mean_before"), F.avg("_b").alias("mean_after"),
        F.stddev_pop("_a").alias("std_before"), F.stddev_pop("_b").alias("std_after"),
    )


def read_back_distributions(before: DataFrame, after: DataFrame, group: Sequence[str], value: str, target: DataFrame, intervals: int) -> DataFrame:
    """Moments and quantiles of the positive values before and after, and their distance from the reference curve (group, i, q)."""
    group = list(group)
    both = before.select(*group, F.lit("before").alias("version"), value).unionByName(after.select(*group, F.lit("after").alias("version"), value)).where(F.col(value) > 0)
    keys = [*group, "version"]
    moments = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = exact_quantiles(both, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99})
    grids = target.withColumn("version", F.explode(F.array(F.lit("before"), F.lit("after"))))
    distance = normalize.distribution_distance(both, keys, value, grids, intervals)
    out = moments.join(q, keys).join(distance, keys)
    return out.select(*keys, "n", "mean", "std", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "p95", "p99", "cdf_max_error", "wasserstein_over_iqr")


def roster_equality(a: DataFrame, b: DataFrame, index: str, subject: str) -> DataFrame:
    """Positions where two runs list different subjects."""
    both = a.select(index, F.col(subject).alias("a")).join(b.select(index, F.col(subject).alias("b")), index, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def artifact_audit(spark_range: DataFrame, artifacts: DataFrame, index: str, rules: Mapping[str, Column]) -> DataFrame:
    """Status of each expected artifact: INCOMPLETE without one, FAIL when repeated or a rule breaks, else PASS."""
    counted = artifacts.groupBy(index).agg(F.count(F.lit(1)).alias("_n"), *[F.bool_and(F.coalesce(ok, F.lit(False))).alias(f"_r_{name}") for name, ok in rules.items()])
    both = spark_range.join(counted, index, "left")
    broken = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "repeated"), *[F.when(~F.col(f"_r_{name}"), name) for name in rules]
    ))
    out = both.withColumn("problems", broken)
    status = F.when(F.col("_n").isNull(), "INCOMPLETE").when(F.size("problems") > 0, "FAIL").otherwise("PASS")
    return out.select(index, "problems", status.alias("status"))


def parity_summary(checks: DataFrame, cohort: str) -> DataFrame:
    """Largest absolute difference, reasons and pair counts by status per cohort. Reasons are a fixed vocabulary."""
    return checks.groupBy(cohort).agg(
        F.max(F.abs(F.col("difference"))).alias("max_abs_difference"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_pairs") for s in ("PASS", "INCOMPLETE", "FAIL")],
    )


def inventory_reasons(df: DataFrame, visit: Sequence[str], modality: str, expected: Sequence[str]) -> DataFrame:
    """READY when every expected modality has exactly one candidate, with the reasons where not."""
    counts = df.groupBy(*visit).agg(*[F.count_if(F.col(modality) == m).alias(f"_n_{m}") for m in expected])
    reasons = F.array_compact(F.array(*[
        F.when(F.col(f"_n_{m}") == 0, F.lit(f"missing_{m}")).when(F.col(f"_n_{m}") > 1, F.lit(f"several_{m}")) for m in expected
    ]))
    return counts.select(*visit, reasons.alias("reasons"), F.when(F.size(reasons) == 0, "READY").otherwise("PARTIAL").alias("status"))


