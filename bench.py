"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from cohortlens import catalog
from cohortlens.session import local_session

# Scored-element evaluation, ranking, cohorts and audits, resampling, distributions, arrays, streaming.
HEADLINE = (
    "flagship_evaluation", "a8_threshold_sweep", "i10_otsu_threshold", "a9_average_precision", "a10_average_precision_global", "a14_binary_metrics",
    "l4_participant_split", "l7_balance_by_z", "l9_matched_pairs", "n1_record_audit", "n2_pair_audit", "v1_paired_bootstrap", "v2_pair_swap_test",
    "d1_distribution_summary", "d16_mutual_information", "d27_grouped_score_summary", "m2_robust_iqr", "m10_quantile_match", "u4_multiset_difference",
    "i1_median_filter_3d", "i4_connected_components", "k3_radial_profile", "k5_feature_vector", "t1_streaming_sweep",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalog.load_all()
    # One small query first, so that JVM start-up is not charged to a headline query.
    catalog.QUERIES["a1_confusion_counts"](spark, sf).count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        spark.catalog.clearCache()
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "lineitem_rows": rows,
        "rows_per_second": {name: round(rows / max(s, 1e-3)) for name, s in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
