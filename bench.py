"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_QUERIES (optional,
comma-separated) other queries of the registry.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskgrove.catalog import REGISTRY  # noqa: E402
from riskgrove.session import local_session  # noqa: E402

HEADLINE = [
    "p04_missing_report",
    "p05_describe_numeric",
    "p06_describe_categorical",
    "d01_histogram_density",
    "d03_kde",
    "d05_ecdf",
    "d07_box_by_category",
    "s01_pearson_matrix",
    "s02_spearman_matrix",
    "s06_kruskal_h",
    "s07_mann_whitney",
    "x09_salary_zscore",
    "b07_risk_tertiles",
    "k09_target_encoding",
    "k11_standardise_on_train",
    "f03_iqr_outliers",
    "a03_risk_shares",
    "a06_location_industry",
    "o02_top_titles_high",
    "v01_stratified_split",
    "l10_mutual_information",
    "m06_macro_auc",
    "m11_compare_models",
    "c06_calinski_harabasz",
    "c07_davies_bouldin",
    "r03_frequent_itemsets",
    "r06_rule_metrics",
    "h03_global_importance",
    "h08_high_low_comparison",
    "l03_forest_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "riskgrove-bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["a03_risk_shares"].build(spark, sf_dir).count()  # starts the JVM's caches
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
