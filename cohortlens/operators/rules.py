"""Rules of manifests, model grids and inventories (N5, N6, N18), and of releases (P18): (rule, key) for everything that breaks one.

Rules of a row are evaluated together in one pass. Rules of a key (a pair, a participant) come from counts that are made
with a map-side combine, per participant first and per pair then, so a hot pair or participant is one row per task.
Comparisons with other tables are equi-joins on keys that are made unique before; a repeated key is a finding of its own.
Tables of sources and files are dealt to as many tasks as their rows need, so what a task holds does not grow with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.audits import expectations, rule_violations
from cohortlens.operators.scale import tasks_for
from cohortlens.operators.sets import duplicates, require_empty, tagged, union

SPLITS = ("train", "val", "test")
MANIFEST_RULES = (
    "missing_split", "empty_participant_id", "empty_pair_id", "invalid_label", "label_source_mismatch", "target_split_mismatch", "manifest_shape",
    "invalid_source_identity", "duplicate_manifest_row", "pair_crosses_splits", "participant_conflicting_labels", "pair_participant_count",
    "pair_labels_not_01", "manifest_count_differs",
)
GRID_RULES = (
    "pair_histogram", "participant_overlap", "z_norm", "support", "zero_mask", "duplicate_source_key", "duplicate_mixed_split_local_key",
    "missing_split_local_key", "missing_mixed_split_local_key", "missing_underlying_source_key", "metadata_mismatch", "mixed_underlying_metadata_mismatch",
    "participant_has_multiple_output_splits", "healthy_map_changed", "lesion_map_changed", "participant_not_in_expected_map", "expected_split_differs",
)
INVENTORY_RULES = (
    "duplicate_candidate_participant_z", "candidate_rows_do_not_match_support_counts", "candidate_row_count_mismatch", "ledger_subject_repeated",
    "ledger_subject_missing", "ledger_subject_unknown", "audit_not_pass", "tensor_parity_fail",
)


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def report(violations: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(rule, failures, status): every rule of the list, PASS where nothing breaks it."""
    spark = violations.sparkSession
    found = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("failures"))
    every = spark.createDataFrame([(r,) for r in rules], "rule string").join(found, "rule", "left")
    failures = F.coalesce("failures", F.lit(0))
    return every.select("rule", failures.alias("failures"), F.when(failures == 0, "PASS").otherwise("FAIL").alias("status"))


def validate_manifest(rows: DataFrame, shape: Sequence[int], lesion_sources: Sequence[str], expected: DataFrame | None = None, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Identity, label and pair rules of a frozen manifest.

    ``rows`` has split (the file a row stands in), row_split (what the row says, may be empty), participant, pair_id, label,
    source_dataset, source_split, source_key, case_id, z, model_shape. A row without a label of 0 or 1 breaks only the rules
    on ids and label; a row without label or source identity takes no part in the rules of keys and in the counts. Nulls count as empty.
    ``expected`` is (measure, n) with the frozen counts: ``records``, ``pairs`` and ``split:<name>``; a measure that is not
    listed is not compared. The labels of a pair are those of its two participants, each of which must have one.
    """
    rows = rows.where(F.col("split").isin(*splits))
    text = {c: _text(c) for c in ("participant", "pair_id", "source_dataset", "source_split", "source_key", "case_id", "row_split")}
    label = F.col("label").cast("int")
    labelled = F.coalesce(label.isin(0, 1), F.lit(False))
    identified = (text["source_dataset"] != "") & (text["source_split"] != "") & (text["source_key"] != "") & F.coalesce(F.col("z") >= 0, F.lit(False))
    per_row = {
        "empty_participant_id": text["participant"] != "",
        "empty_pair_id": text["pair_id"] != "",
        "invalid_label": labelled,
        "label_source_mismatch": ~labelled | ((label == 1) == F.lower(text["source_dataset"]).isin(*lesion_sources)),
        "target_split_mismatch": ~labelled | (text["row_split"] == "") | (text["row_split"] == F.col("split")),
        "manifest_shape": ~labelled | (F.col("model_shape") == F.array(*[F.lit(int(n)) for n in shape])),
        "invalid_source_identity": ~labelled | identified,
    }
    key = F.concat_ws(":", "split", text["source_dataset"], text["source_split"], text["source_key"], text["participant"], text["pair_id"], F.coalesce(F.col("z").cast("string"), F.lit("")))
    valid = rows.where(labelled & identified).select("split", *[c.alias(n) for n, c in text.items() if n != "row_split"], "z", label.alias("label"))
    identity = ["split", "source_dataset", "source_split", "source_key", "participant", "case_id", "z", "pair_id", "label"]
    people = valid.where("pair_id <> ''").groupBy("pair_id", "participant").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("split").alias("s0"), F.max("split").alias("s1"))
    pairs = people.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("lo") == F.col("hi")).alias("single"), F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    per_pair = {
        "pair_crosses_splits": F.col("s0") == F.col("s1"),
        "pair_participant_count": F.col("n") == 2,
        "pair_labels_not_01": (F.col("n") != 2) | ((F.col("lo") == 0) & (F.col("hi") == 1) & F.col("single")),
    }
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(s,) for s in splits], "split string")
    found = [
        rule_violations(rows, key, per_row),
        tagged("duplicate_manifest_row", duplicates(valid, identity), F.concat_ws(":", *identity)),
        rule_violations(pairs, F.col("pair_id"), per_pair),
        tagged("participant_conflicting_labels", people.where("lo < hi"), F.concat_ws(":", "pair_id", "participant")),
        tagged("missing_split", wanted.join(rows.select("split").distinct(), "split", "left_anti"), F.col("split")),
    ]
    if expected is not None:
        per_split = valid.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        actual = union([
            per_split.select(F.concat(F.lit("split:"), "split").alias("measure"), "n"),
            valid.agg(F.count(F.lit(1)).alias("n")).select(F.lit("records").alias("measure"), "n"),
            pairs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pairs").alias("measure"), "n"),
        ]).withColumnRenamed("n", "actual")
        compared = expected.join(actual, "measure", "left").where(F.coalesce("actual", F.lit(0)) != F.col("n"))
        found.append(tagged("manifest_count_differs", compared, F.col("measure")))
    return union(found)


def grid_rows(records: DataFrame, files: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Depth, support and zero-mask rules of the rows of a model grid. ``files`` lists the paths that exist.

    Support is one share per channel, three in all. A lesion row counts as free of lesions only if both masks were looked
    at, are empty, and the native one is on disk.
    """
    share = F.col("support")
    listed = files.select(F.col("path").alias("seg_path")).repartition(tasks_for(files), "seg_path").distinct().withColumn("_file", F.lit(True))
    lesion = F.coalesce(F.col("label") == 1, F.lit(False))
    rules = {
        "z_norm": F.abs(F.col("z_norm") - F.col("z") / (depth - 1)) <= 1e-12,
        "support": (F.size(share) == 3) & F.forall(share, lambda v: F.coalesce(v + 1e-12 >= threshold, F.lit(False))),
        "zero_mask": ~lesion | ((F.col("native_voxels") == 0) & (F.col("mask_voxels") == 0) & F.col("native_checked") & F.col("mask_checked") & F.col("_file")),
    }
    return rule_violations(records.join(listed, "seg_path", "left"), F.col("record_id"), rules)


def pair_histograms(records: DataFrame, summaries: DataFrame, cap: int = 2) -> DataFrame:
    """Summarized pairs whose labels differ in their slices per depth bin, or that exceed the cap in one."""
    per_bin = records.where("label IN (0, 1)").groupBy("pair_id", "z_bin").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    bad = per_bin.where((F.col("n0") != F.col("n1")) | (F.col("n0") > cap)).select("pair_id").distinct()
    return tagged("pair_histogram", bad.join(summaries.select("pair_id").distinct(), "pair_id", "left_semi"), F.col("pair_id"))


def _unique(index: DataFrame, keys: Sequence[str], values: Sequence[str], tasks: int) -> DataFrame:
    """One row per key: the smallest values and the number of copies. Equal rows are counted first and the values of a key
    compared in parts, so neither many copies nor many values of one key have to be sorted by one task."""
    part = F.pmod(F.xxhash64(*values), F.lit(tasks)).alias("_part")
    dealt = index.select(*keys, *values, part).repartition(tasks, *keys, "_part")
    counted = dealt.groupBy(*keys, *values, "_part").agg(F.count(F.lit(1)).alias("_copies"))
    parts = counted.groupBy(*keys, "_part").agg(F.min(F.struct(*values)).alias("_v"), F.sum("_copies").alias("_copies"))
    return parts.repartition(tasks, *keys).groupBy(*keys).agg(F.min("_v").alias("_v"), F.sum("_copies").alias("_copies"))


def source_joins(records: DataFrame, sources: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """Healthy rows against the tables they come from.

    ``sources`` is (source_dataset, source_split, source_key, participant, case_id, z). Without ``mixed`` a row points to it
    by (source_dataset, source_split, source_key). With ``mixed``, (source_split, mixed_local_key, source_dataset,
    source_key), it points by (source_split, source_key) to the mixed table and from there to the underlying source. Of a
    repeated key the smallest row is compared, and the key is reported.
    """
    healthy = records.where("label = 0").select("record_id", "source_dataset", "source_split", "source_key", "participant", "case_id", "z")
    keys = ["source_dataset", "source_split", "source_key"]
    index = _unique(sources, keys, ["participant", "case_id", "z"], tasks_for(sources))
    repeated = [tagged("duplicate_source_key", index.where("_copies > 1"), F.concat_ws(":", *keys))]
    names = ("missing_split_local_key", "metadata_mismatch")
    if mixed is not None:
        names = ("missing_underlying_source_key", "mixed_underlying_metadata_mismatch")
        local = _unique(mixed, ["source_split", "mixed_local_key"], ["source_dataset", "source_key"], tasks_for(mixed))
        repeated.append(tagged("duplicate_mixed_split_local_key", local.where("_copies > 1"), F.concat_ws(":", "source_split", "mixed_local_key")))
        to = local.select("source_split", F.col("mixed_local_key").alias("source_key"), F.col("_v").alias("_to"))
        healthy = healthy.join(to, ["source_split", "source_key"], "left")
        repeated.append(tagged("missing_mixed_split_local_key", healthy.where("_to IS NULL"), F.col("record_id")))
        healthy = healthy.where("_to IS NOT NULL").withColumns({"source_dataset": F.col("_to.source_dataset"), "source_key": F.col("_to.source_key")})
    met = healthy.join(index.select(*keys, "_v"), keys, "left")
    same = F.struct(*[F.col(c).cast("string") for c in ("participant", "case_id", "z")]).eqNullSafe(F.struct(*[F.col(f"_v.{c}").cast("string").alias(c) for c in ("participant", "case_id", "z")]))
    verdict = F.when(F.col("_v").isNull(), names[0]).when(~same, names[1])
    return union([met.select(verdict.alias("rule"), F.col("record_id").cast("string").alias("key")).where("rule IS NOT NULL"), *repeated])


def split_maps(records: DataFrame, maps: DataFrame, expected: DataFrame) -> DataFrame:
    """Overlap of splits, reuse of the frozen maps, and the expected map of the cohort.

    ``maps`` is (map, participant, split) with the maps ``healthy`` and ``lesion``; a participant that a map does not list is
    new and free. ``expected`` is (participant, split) and has to list every healthy participant.
    """
    seen = records.where(F.col("split").isNotNull()).groupBy("participant", "split").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if(F.col("label") == 0).alias("n0"))
    people = seen.groupBy("participant").agg(
        F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_set(F.when(F.col("n0") > 0, F.col("split")))).alias("healthy"), F.max("hi").alias("hi"))
    # A participant has at most one entry per split.
    pairs = F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.concat_ws("|", a, b))))
    overlap = people.where(F.size("splits") > 1).select("participant", F.explode(pairs).alias("both"))
    old = maps.groupBy("participant").agg(*[F.min(F.when(F.col("map") == m, F.col("split"))).alias(f"_{m}") for m in ("healthy", "lesion")])
    wanted = expected.groupBy("participant").agg(F.min("split").alias("_expected"))
    met = people.join(old, "participant", "left").join(wanted, "participant", "left")
    only = F.when(F.size("splits") == 1, F.col("splits")[0])
    rules = {
        "participant_has_multiple_output_splits": only.isNotNull(),
        "healthy_map_changed": only.isNull() | F.col("_healthy").isNull() | (F.col("_healthy") == only),
        "lesion_map_changed": F.coalesce(F.col("hi") != 1, F.lit(True)) | F.col("_lesion").isNull() | (F.col("splits") == F.array("_lesion")),
        "participant_not_in_expected_map": (F.size("healthy") == 0) | F.col("_expected").isNotNull(),
        "expected_split_differs": (F.size("healthy") == 0) | F.col("_expected").isNull() | (F.col("healthy") == F.array("_expected")),
    }
    return union([rule_violations(met, F.col("participant"), rules), tagged("participant_overlap", overlap, F.concat_ws(":", "both", "participant"))])


def unselected(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Participants of the expected map without a healthy row: no failure, but reported."""
    return expected.select("participant").distinct().join(records.where("label = 0").select("participant").distinct(), "participant", "left_anti")


def grid_audit(records: DataFrame, summaries: DataFrame, files: DataFrame, sources: DataFrame, mixed: DataFrame | None, maps: DataFrame, expected: DataFrame, depth: int, threshold: float, cap: int = 2) -> DataFrame:
    """All rules of a model grid (N6); see the single checks for their inputs."""
    return union([
        grid_rows(records, files, depth, threshold), pair_histograms(records, summaries, cap),
        source_joins(records, sources, mixed), split_maps(records, maps, expected),
    ])


def inventory_audit(candidates: DataFrame, inventory: DataFrame, ledger: DataFrame, audits: DataFrame, comparisons: Sequence[str], total: int | None = None) -> DataFrame:
    """Completeness of a candidate inventory.

    ``candidates`` is (subject, participant, z), ``inventory`` (subject, support_slices), ``ledger`` (subject), ``audits``
    (comparison, check, status). Each subject has as many candidates as slices passed the support rule, on either side;
    (participant, z) is unique; the ledger lists each subject of the inventory once and no other; the check ``status`` of every
    comparison is PASS, and ``tensor_parity`` is not FAIL (it need not apply). ``total`` is the number of rows the inventory
    states; without it the sum of the support counts.
    """
    want = inventory.groupBy("subject").agg(F.sum("support_slices").alias("n"))
    have = candidates.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    off = expectations(have.withColumn("n", F.col("n").cast("long")), want.withColumn("n", F.nullif(F.col("n"), F.lit(0))), ["subject"], "n").where("NOT ok")
    stated = candidates.sparkSession.range(1).select(F.lit(total).cast("long").alias("want")) if total is not None else want.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("want"))
    counted = candidates.agg(F.count(F.lit(1)).alias("have"))
    both = union([counted.select("have", F.lit(None).cast("long").alias("want")), stated.select(F.lit(None).cast("long").alias("have"), "want")]).agg(F.max("have").alias("have"), F.max("want").alias("want"))
    listed = ledger.groupBy("subject").agg(F.count(F.lit(1)).alias("copies"))
    status = audits.groupBy("comparison").agg(F.max(F.when(F.col("check") == "status", F.col("status"))).alias("status"), F.max(F.when(F.col("check") == "tensor_parity", F.col("status"))).alias("parity"))
    required = candidates.sparkSession.createDataFrame([(c,) for c in comparisons], "comparison string").join(status, "comparison", "left")
    rules = {"audit_not_pass": F.col("status") == "PASS", "tensor_parity_fail": ~F.col("parity").eqNullSafe("FAIL")}
    return union([
        tagged("duplicate_candidate_participant_z", duplicates(candidates, ["participant", "z"]), F.concat_ws(":", "participant", "z")),
        tagged("candidate_rows_do_not_match_support_counts", off, F.col("subject")),
        tagged("candidate_row_count_mismatch", both.where("have <> want"), F.concat_ws(":", "have", "want")),
        tagged("ledger_subject_repeated", listed.where("copies > 1"), F.col("subject")),
        tagged("ledger_subject_missing", want.join(listed, "subject", "left_anti"), F.col("subject")),
        tagged("ledger_subject_unknown", listed.join(want, "subject", "left_anti"), F.col("subject")),
        rule_violations(required, F.col("comparison"), rules),
    ])


def release_findings(records: DataFrame, id_col: str, configured: DataFrame, review: DataFrame, remaining: int | None = None, per_split: DataFrame | None = None, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """What keeps a release from being cut by a configured list of exclusions (P18): (rule, key), empty if nothing does.

    ``records`` is (id, split, …), ``configured`` (id), ``review`` (id, manual_status). The configured ids must be those that
    were adjudicated EXCLUDE, exist in the source and stand in the review queue. ``remaining`` and ``per_split``, (split, n), are the
    numbers of ids that have to be left; every split of the list must keep one.
    """
    listed, known = configured.select(id_col).distinct(), records.select(id_col).distinct()
    queue = review.groupBy(id_col).agg(F.bool_or(F.coalesce(F.col("manual_status") == "EXCLUDE", F.lit(False))).alias("_out"))
    judged = queue.where("_out")
    kept = records.join(listed, id_col, "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("have"))
    wanted = records.sparkSession.createDataFrame([(s,) for s in splits], "split string").join(kept, "split", "left")
    found = [
        tagged("configured_absent_from_source", listed.join(known, id_col, "left_anti"), F.col(id_col)),
        tagged("configured_only", listed.join(judged, id_col, "left_anti"), F.col(id_col)),
        tagged("adjudicated_only", judged.join(listed, id_col, "left_anti"), F.col(id_col)),
        tagged("absent_from_review_queue", listed.join(queue, id_col, "left_anti"), F.col(id_col)),
        tagged("split_left_empty", wanted.where("have IS NULL"), F.col("split")),
    ]
    if remaining is not None:
        total = kept.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("have"))
        found.append(tagged("remaining_count_differs", total.where(F.col("have") != remaining), F.col("have")))
    if per_split is not None:
        both = wanted.join(per_split, "split", "full_outer").where(F.coalesce("have", F.lit(0)) != F.coalesce("n", F.lit(0)))
        found.append(tagged("split_count_differs", both, F.col("split")))
    return union(found)


def select_release(records: DataFrame, id_col: str, configured: DataFrame, review: DataFrame, **expected) -> DataFrame:
    """The records without the configured exclusions, splits as they are; an error with the first findings if there are any."""
    require_empty(release_findings(records, id_col, configured, review, **expected), "release cannot be selected")
    return records.join(configured.select(id_col).distinct(), id_col, "left_anti")
