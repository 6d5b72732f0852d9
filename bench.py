"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_readings",
    "descriptive_stats_gauges",
    "quantiles_price",
    "outlier_summary_gauges",
    "cramers_v_gauges",
    "leakage_scan_gauges",
    "correlation_matrix_gauges",
    "mutual_information",
    "stratified_split",
    "stratified_folds",
    "metric_suite",
    "metric_suite_by_fold",
    "roc_points",
    "calibration_points",
    "mcnemar_pairwise",
    "robustness_extended",
    "noise_curve",
    "threshold_rules",
    "tree_fidelity_by_group",
    "permutation_importance",
    "shapley_values",
    "model_gaussiannb",
    "model_ridge_classifier",
    "model_logistic_regression",
    "model_decision_tree",
    "model_gradient_boosting",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from gaugelab.catalog import QUERIES
    from gaugelab.plans.bindings import sensors, table
    from gaugelab.storage import local_session

    spark = local_session("bench", cpus)
    # The JVM compiles its first plans slowly; that is not part of any query.
    QUERIES["metric_suite"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    rows = {"sensors": sensors(spark, sf_dir).count(), "gauges": table(spark, sf_dir, "lineitem").count()}

    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "rows": rows, "cpus": int(cpus) if cpus.isdigit() else cpus}))


if __name__ == "__main__":
    main()
