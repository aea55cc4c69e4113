"""Rules of manifests, grids and inventories against findings written down by hand and against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import rules, scale
from cohortlens.operators.sets import AuditError
from cohortlens.plans import sql_templates

MANIFEST = "split string, row_split string, participant string, pair_id string, label int, source_dataset string, source_split string, source_key string, case_id string, z int, model_shape array<int>"


def found(df):
    return sorted((r.rule, r.key) for r in df.collect())


def row(split="train", participant="a", pair="p", label=0, source="Healthy", key="k", z=1, shape=(4, 4), row_split=None, case="c"):
    return (split, row_split, participant, pair, label, source, "s", key, case, z, list(shape))


def expected_of(rows, shape, lesions):
    """The rules of a manifest, row after row."""
    out, seen, people, splits = set(), Counter(), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for split, row_split, participant, pair, label, source, part, key, case, z, dims in rows:
        name = ":".join([split, source, part, key or "", (participant or "").strip(), (pair or "").strip(), "" if z is None else str(z)])
        participant, pair = (participant or "").strip(), (pair or "").strip()
        out |= {("empty_participant_id", name)} if not participant else set()
        out |= {("empty_pair_id", name)} if not pair else set()
        if label not in (0, 1):
            out.add(("invalid_label", name))
            continue
        out |= {("label_source_mismatch", name)} if (label == 1) != (source.lower() in lesions) else set()
        out |= {("target_split_mismatch", name)} if row_split and row_split != split else set()
        out |= {("manifest_shape", name)} if tuple(dims) != shape else set()
        if not key or z is None or z < 0:
            out.add(("invalid_source_identity", name))
            continue
        seen[":".join([split, source, part, key, participant, case, str(z), pair, str(label)])] += 1
        if pair:
            people[pair][participant].add(label)
            splits[pair].add(split)
    out |= {("duplicate_manifest_row", k) for k, n in seen.items() if n > 1}
    for pair, labels in people.items():
        out |= {("pair_crosses_splits", pair)} if len(splits[pair]) > 1 else set()
        out |= {("participant_conflicting_labels", f"{pair}:{p}") for p, s in labels.items() if len(s) > 1}
        if len(labels) != 2:
            out.add(("pair_participant_count", pair))
        elif sorted(map(sorted, labels.values())) != [[0], [1]]:
            out.add(("pair_labels_not_01", pair))
    return out


def test_manifest_rules(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        pair = rng.choice(["", None, *(f"p{i}" for i in range(40))])
        rows.append(row(rng.choice(["train", "train", "train", "val"]), rng.choice([f"{pair}a", f"{pair}b", " ", None] if rng.random() < 0.1 else [f"{pair}a", f"{pair}b"]), pair, rng.choice([0, 0, 1, 1, 1, 2, None]),
                        rng.choice(["Healthy", "LESION"]), rng.choice(["k1", "k2", "k3", "", None]), rng.choice([0, 1, None, -1]), rng.choice([(4, 4), (4, 4), (4, 2)]), rng.choice([None, "", "train", "test"])))
    got = {(r.rule, r.key) for r in rules.validate_manifest(spark.createDataFrame(rows, MANIFEST), (4, 4), ["lesion"]).collect()}
    assert got == expected_of(rows, (4, 4), {"lesion"}) | {("missing_split", "test")}
    assert {r for r, _ in got} == set(rules.MANIFEST_RULES) - {"manifest_count_differs"}


def test_clean_and_empty_manifest(spark):
    clean = [row(s, f"{s}{p}", s, label, "Lesion" if label else "Healthy", f"{p}{z}", z) for s in rules.SPLITS for p, label in (("a", 0), ("b", 1)) for z in (1, 2)]
    counts = spark.createDataFrame([("records", 12), ("pairs", 3), ("split:val", 4)], "measure string, n long")
    data = spark.createDataFrame(clean, MANIFEST)
    assert found(rules.validate_manifest(data, (4, 4), ["lesion"], counts)) == []
    assert {r.status for r in rules.report(rules.validate_manifest(data, (4, 4), ["lesion"]), rules.MANIFEST_RULES).collect()} == {"PASS"}
    # Rows of other splits do not belong to the manifest; without any row every count and split is missing.
    other = spark.createDataFrame([row("extra", "", "", 9)], MANIFEST)
    assert found(rules.validate_manifest(other, (4, 4), ["lesion"], counts)) == sorted(
        [("manifest_count_differs", m) for m in ("records", "pairs", "split:val")] + [("missing_split", s) for s in rules.SPLITS])


def test_grid_rows(spark):
    schema = "record_id string, label int, z int, z_norm double, support array<double>, native_voxels int, mask_voxels int, native_checked boolean, mask_checked boolean, seg_path string"
    good = [0.2, 0.3, 0.2 - 1e-13]
    rows = [("ok", 1, 3, 0.5, good, 0, 0, True, True, "/a"), ("healthy", 0, 0, 0.0, good, None, None, None, None, None), ("z", 0, 3, 0.4, good, 0, 0, True, True, "/a"), ("no_z", 0, None, 0.4, good, 0, 0, True, True, "/a"),
            ("thin", 0, 6, 1.0, [0.2, 0.1, 0.2], 0, 0, True, True, "/a"), ("two", 0, 6, 1.0, [0.2, 0.2], 0, 0, True, True, "/a"), ("hole", 0, 6, 1.0, [0.2, None, 0.2], 0, 0, True, True, "/a"), ("none", 0, 6, 1.0, None, 0, 0, True, True, "/a"),
            ("voxel", 1, 6, 1.0, good, 1, 0, True, True, "/a"), ("mask", 1, 6, 1.0, good, 0, 1, True, True, "/a"), ("unchecked", 1, 6, 1.0, good, 0, 0, None, True, "/a"), ("gone", 1, 6, 1.0, good, 0, 0, True, True, "/b")]
    files = spark.createDataFrame([("/a",), ("/a",)], "path string")
    got = found(rules.grid_rows(spark.createDataFrame(rows, schema), files, 7, 0.2))
    assert got == sorted([("z_norm", "z"), ("z_norm", "no_z")] + [("support", k) for k in ("thin", "two", "hole", "none")] + [("zero_mask", k) for k in ("voxel", "mask", "unchecked", "gone")])


def test_pair_histograms(spark):
    rows = [("even", 1, 0), ("even", 1, 1), ("odd", 1, 0), ("odd", 2, 1), ("full", 1, 0), ("full", 1, 1)] + [("full", 1, n % 2) for n in range(4)] + [("unlisted", 1, 0)]
    pairs = spark.createDataFrame([("even",), ("odd",), ("full",), ("absent",)], "pair_id string")
    assert found(rules.pair_histograms(spark.createDataFrame(rows, "pair_id string, z_bin int, label int"), pairs)) == [("pair_histogram", "full"), ("pair_histogram", "odd")]


def test_source_joins(spark):
    schema = "record_id string, label int, source_dataset string, source_split string, source_key string, participant string, case_id string, z int"
    base = spark.createDataFrame([("d", "s", "1", "a", "c", 1), ("d", "s", "2", "a", "c", 2), ("d", "s", "2", "a", "c", 2), ("e", "s", "1", "b", "c", 1)], "source_dataset string, source_split string, source_key string, participant string, case_id string, z int")
    rows = [("same", 0, "d", "s", "1", "a", "c", 1), ("moved", 0, "d", "s", "2", "a", "c", 3), ("gone", 0, "d", "t", "1", "a", "c", 1), ("nobody", 0, "e", "s", "1", None, "c", 1), ("lesion", 1, "d", "t", "9", "a", "c", 1)]
    assert found(rules.source_joins(spark.createDataFrame(rows, schema), base)) == [
        ("duplicate_source_key", "d:s:2"), ("metadata_mismatch", "moved"), ("metadata_mismatch", "nobody"), ("missing_split_local_key", "gone")]
    mixed = spark.createDataFrame([("s", "m1", "d", "1"), ("s", "m2", "d", "2"), ("s", "m2", "d", "2"), ("s", "m3", "d", "9")], "source_split string, mixed_local_key string, source_dataset string, source_key string")
    rows = [("same", 0, "mixed", "s", "m1", "a", "c", 1), ("moved", 0, "mixed", "s", "m2", "a", "x", 2), ("lost", 0, "mixed", "s", "m3", "a", "c", 1), ("gone", 0, "mixed", "s", "m4", "a", "c", 1)]
    assert found(rules.source_joins(spark.createDataFrame(rows, schema), base, mixed)) == [
        ("duplicate_mixed_split_local_key", "s:m2"), ("duplicate_source_key", "d:s:2"), ("missing_mixed_split_local_key", "gone"), ("missing_underlying_source_key", "lost"), ("mixed_underlying_metadata_mismatch", "moved")]


def test_sources_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_AT_ONCE", 25)
    keys = "source_dataset string, source_split string, source_key string"
    base = spark.range(700).selectExpr("'d' AS source_dataset", "'s' AS source_split", "CASE WHEN id < 300 THEN 'many' WHEN id < 600 THEN 'copies' ELSE CAST(id AS STRING) END AS source_key",
                                       "'p' AS participant", "'c' AS case_id", "CAST(CASE WHEN id < 300 THEN 299 - id ELSE 7 END AS INT) AS z")
    rows = [("least", 0, "d", "s", "many", "p", "c", 0), ("other", 0, "d", "s", "many", "p", "c", 1), ("copy", 0, "d", "s", "copies", "p", "c", 7), ("last", 0, "d", "s", "699", "p", "c", 7)]
    out = rules.source_joins(spark.createDataFrame(rows, f"record_id string, label int, {keys}, participant string, case_id string, z int"), base)
    assert found(out) == [("duplicate_source_key", "d:s:copies"), ("duplicate_source_key", "d:s:many"), ("metadata_mismatch", "other")]
    # 28 tasks for the 700 rows, which the planner does not join into few.
    assert ", 28), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    files = spark.range(700).select(F.concat(F.lit("/"), "id").alias("path"))
    listed = rules.grid_rows(spark.createDataFrame([("gone", 1, 6, 1.0, [0.2] * 3, 0, 0, True, True, "/x"), ("ok", 1, 6, 1.0, [0.2] * 3, 0, 0, True, True, "/699")],
        "record_id string, label int, z int, z_norm double, support array<double>, native_voxels int, mask_voxels int, native_checked boolean, mask_checked boolean, seg_path string"), files, 7, 0.2)
    assert found(listed) == [("zero_mask", "gone")]
    assert ", 28), REPARTITION_BY_NUM" in listed._jdf.queryExecution().executedPlan().toString()


def test_split_maps(spark):
    rows = [("ok", "train", 0), ("ok", "train", 0), ("two", "train", 0), ("two", "val", 0), ("moved", "val", 0), ("new", "test", 0), ("sick", "val", 1), ("sick_new", "val", 1), ("both", "test", 1), ("both", "val", 1), ("none", None, 0)]
    data = spark.createDataFrame(rows, "participant string, split string, label int")
    maps = spark.createDataFrame([("healthy", "ok", "train"), ("healthy", "two", "test"), ("healthy", "moved", "train"), ("lesion", "sick", "train"), ("lesion", "both", "test"), ("lesion", "ok", "val")], "map string, participant string, split string")
    expected = spark.createDataFrame([("ok", "train"), ("two", "train"), ("moved", "val"), ("absent", "val")], "participant string, split string")
    assert found(rules.split_maps(data, maps, expected)) == sorted([
        ("participant_overlap", "train|val:two"), ("participant_overlap", "test|val:both"), ("participant_has_multiple_output_splits", "two"), ("participant_has_multiple_output_splits", "both"),
        ("healthy_map_changed", "moved"), ("lesion_map_changed", "sick"), ("lesion_map_changed", "both"), ("participant_not_in_expected_map", "new"), ("expected_split_differs", "two")])
    assert [r.participant for r in rules.unselected(data, expected).collect()] == ["absent"]


def test_inventory(spark):
    candidates = spark.createDataFrame([("a", "a", 1), ("a", "a", 2), ("b", "b", 1), ("b", "b", 1), ("x", "x", 0)], "subject string, participant string, z int")
    inventory = spark.createDataFrame([("a", 2), ("b", 1), ("empty", 0), ("c", 3)], "subject string, support_slices int")
    ledger = spark.createDataFrame([("a",), ("b",), ("b",), ("empty",), ("y",)], "subject string")
    audits = spark.createDataFrame([("one", "status", "PASS"), ("one", "tensor_parity", "NOT_APPLICABLE"), ("two", "status", "FAIL"), ("three", "status", "PASS"), ("three", "tensor_parity", "FAIL")], "comparison string, check string, status string")
    assert found(rules.inventory_audit(candidates, inventory, ledger, audits, ["one", "two", "three", "four"])) == sorted(
        [("duplicate_candidate_participant_z", "b:1"), ("candidate_row_count_mismatch", "5:6"), ("ledger_subject_repeated", "b"), ("ledger_subject_missing", "c"), ("ledger_subject_unknown", "y"), ("audit_not_pass", "two"), ("audit_not_pass", "four"), ("tensor_parity_fail", "three")]
        + [("candidate_rows_do_not_match_support_counts", s) for s in ("b", "c", "x")])
    exact = candidates.where("subject = 'a'")
    assert found(rules.inventory_audit(exact, inventory.where("subject = 'a'"), ledger.where("subject = 'a'"), audits, ["one"], total=2)) == []
    assert found(rules.inventory_audit(exact.where("false"), inventory.where("false"), ledger.where("false"), audits, [], total=1)) == [("candidate_row_count_mismatch", "0:1")]


def test_release(spark):
    records = spark.createDataFrame([(i, "val" if i > 6 else "train") for i in range(1, 10)], "id int, split string")
    listed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    review = spark.createDataFrame([(1, "EXCLUDE"), (8, "EXCLUDE"), (2, "KEEP"), (3, None)], "id int, manual_status string")
    counts = spark.createDataFrame([("train", 5), ("val", 2)], "split string, n int")
    kept = rules.select_release(records, "id", listed(1, 8, 8), review, remaining=7, per_split=counts)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 9]
    assert found(rules.release_findings(records, "id", listed(1, 2, 4, 99), review, remaining=7, per_split=counts)) == sorted([
        ("configured_only", "2"), ("configured_only", "4"), ("configured_only", "99"), ("configured_absent_from_source", "99"), ("absent_from_review_queue", "4"), ("absent_from_review_queue", "99"),
        ("adjudicated_only", "8"), ("remaining_count_differs", "6"), ("split_count_differs", "train"), ("split_count_differs", "val")])
    with pytest.raises(AuditError):
        rules.select_release(records, "id", listed(1), review)
    everyone = spark.createDataFrame([(i, "EXCLUDE") for i in (7, 8, 9)], "id int, manual_status string")
    assert found(rules.release_findings(records, "id", listed(7, 8, 9), everyone)) == [("split_left_empty", "val")]


def test_names(spark):
    rows = [("UCX-0004_nifti", "/d/s7_T1.nii.gz"), ("UCX-0429_FU003d_nifti", "s8.NII"), ("_nifti", "plain"), ("UCX-1", "/x_y/s9_a_b.nii"), (None, None)]
    got = spark.createDataFrame(rows, "folder string, file string").select(scalars.folder_stem("folder").alias("a"), scalars.file_subject("file").alias("b")).collect()
    assert [tuple(r) for r in got] == [("UCX-0004", "s7"), ("UCX-0429_FU003d", "s8"), (None, "plain"), (None, "s9"), (None, None)]


def test_sql_forms(spark):
    rng = random.Random(2)
    rows = [(f, n, rng.choice([None, float("nan"), 0.0, 1.0, 0.3, 0.3001, rng.random() / 50, rng.random()])) for f in ("a", "b", None) for n in range(60)]
    spark.createDataFrame(rows, "family string, test int, p double").createOrReplaceTempView("tests_of_rules")

    def holm(known):
        out, top = {}, 0.0
        for rank, (p, test) in enumerate(sorted(known)):
            top = max(top, min(1.0, (len(known) - rank) * p))
            out[test] = top
        return out

    def known(f):
        return [(p, t) for g, t, p in rows if g == f and p is not None and p == p]

    got = {(r.family, r.test): r.p_holm for r in spark.sql(sql_templates.holm_sql("tests_of_rules", ["family"], "p")).collect()}
    assert len(got) == len(rows) and got == {(f, t): pytest.approx(holm(known(f))[t], abs=1e-14) if t in holm(known(f)) else None for f, t, _ in rows}
    alone = [(p, t) for p, t in known("a")]
    spark.table("tests_of_rules").where("family = 'a'").createOrReplaceTempView("one_family")
    assert {r.test: r.p_holm for r in spark.sql(sql_templates.holm_sql("one_family", [], "p")).collect() if r.p_holm is not None} == pytest.approx(holm(alone), abs=1e-14)

    scored = [(k, round(rng.uniform(-0.2, 1.2), 2), rng.random() < 0.4) for k in ("x", "y", None) for _ in range(150)] + [("all", 0.5, True)]
    data = spark.createDataFrame(scored, "k string, score double, label boolean")
    data.createOrReplaceTempView("scored")
    by_sql = {r.k: r for r in spark.sql(sql_templates.ranking_sql("scored", ["k"])).collect()}
    for k in ("x", "y", None):
        pos, neg = ([s for g, s, l in scored if g == k and l is want] for want in (True, False))
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        ap = sum(sum(p >= s for p in pos) / sum(v >= s for v in pos + neg) for s in pos) / len(pos)
        assert (by_sql[k].n, by_sql[k].n_pos) == (150, len(pos))
        assert by_sql[k].auc == pytest.approx(wins / len(pos) / len(neg)) and by_sql[k].ap == pytest.approx(ap)
    assert by_sql["all"].auc is None and by_sql["all"].ap == 1.0
    assert spark.sql(sql_templates.ranking_sql("scored", [])).first().n == len(scored)


def test_result_contract(spark):
    rows = [("a", None, "final", None, None, None, "/runs/main"), ("b", "Diagnostic_Fit", "raw", "yes", None, None, None), ("c", None, None, "no", "", "main", None), ("d", None, "registered", None, None, None, None),
            ("e", None, " FINAL", "swap", None, None, None), ("f", None, "", "None", "0", None, None), ("g", "formal_final", "final", None, None, "same-cohort negative", None), ("h", "tiny control", "final", None, None, None, None),
            ("i", None, "final", None, None, "domain_classifier", "/out/domain_controller/x"), ("j", None, "final", None, None, None, "/out/label-SHUFFLE/x"), ("k", "main", "final", "true", None, None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, stage string, flag string, permutation string, purpose string, path string")
    kind = scalars.result_kind(F.col("kind"), F.col("stage"), {"is_control": F.col("flag"), "permutation_index": F.col("permutation"), "purpose": F.col("purpose")}, [F.col("path")])
    got = {r.id: r.k for r in df.select("id", kind.alias("k")).collect()}
    main, control = "formal_final", "control"
    assert got == {"a": main, "b": "diagnostic_formalfit", "c": main, "d": "intermediate", "e": control, "f": control, "g": control, "h": control, "i": main, "j": control, "k": control}
    selector = {"stage": "final", "modalities": "FLAIR+T1", "classifier": "resnet", "seed": 73}
    runs = spark.createDataFrame([("Final", "t1, flair", "ResNet", "73"), (None, "FLAIR+T1", "resnet", "73"), ("final", "T1", "resnet", "73"), ("final", "FLAIR+T1", None, "73"), ("final", "FLAIR+T1", "resnet", "x")], "a string, b string, c string, d string")
    primary = scalars.is_primary(F.col("a"), F.col("b"), F.col("c"), F.col("d"), selector)
    assert [r.p for r in runs.select(primary.alias("p")).collect()] == [True, False, False, False, False]


def test_means_on_a_limit_do_not_depend_on_the_order_of_their_values(spark, tmp_path):
    taxes = {1: [0.01, 0.02, 0.03], 2: [0.03, 0.02, 0.01]}
    spark.createDataFrame([(k, 5, 950.0) for k in taxes], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, 20.0, 0.05, x) for k, xs in taxes.items() for x in xs]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    from cohortlens.catalog import audits as queries

    flags = [r.flags for r in queries.qc_status(spark, str(tmp_path)).collect()]
    assert flags == [["REVIEW:T1_MNI_MI_improvement_nonpositive"]] * 2
