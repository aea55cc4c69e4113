"""Registered queries against their SQL. A cross-section by default, everything with COHORTLENS_ALL=1."""

import os

import duckdb
import pytest

from cohortlens import catalog
from tools.check_oracle import TABLES, rows_of

catalog.load_all()
SOME = ("flagship_evaluation", "a8_threshold_sweep", "a18_yen_summary", "a9_average_precision", "a15_subject_scores", "l1_kfold", "l9_matched_pairs", "l12_pair_label_flip",
        "v3_holm", "v5_case_bootstrap", "d1_distribution_summary", "d16_mutual_information", "d27_grouped_score_summary", "m6_equalize", "m10_quantile_match", "i5_remove_small_components",
        "k5_feature_vector", "j3_manifest_against_predictions", "u4_multiset_difference", "n1_record_audit", "n9_qc_status", "g7_set_digest", "s5_session_discovery", "s10_metric_reader",
        "t2_resume_missing_subjects")
NAMES = sorted(catalog.ORACLE) if os.environ.get("COHORTLENS_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(catalog.ORACLE[name])
    assert mine == rows_of(relation.columns, relation.fetchall())


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 250
