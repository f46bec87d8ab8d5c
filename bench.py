"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores,
``BENCH_ONLY`` (a comma list, or ``all``) other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from waymark.cluster import build_session
from workload import REGISTRY

HEADLINE = (
    "plan_session_features", "plan_wide_users", "plan_munged_users", "plan_reduced_levels",
    "J2_natural_left_join", "A3_mean_sum_count", "A5_count_distinct", "A6_contingency", "A12_profile", "A14_quantiles", "A17_density",
    "A20_counts_by_day", "W2_cumulative_share", "W3_top_n_ties", "W3_top_n_ties_hot", "W8_nucleus", "C4_lump_top5", "C6_lump_fitted",
    "T1_chi_squared", "E2_ndcg_at_5", "E8_score_bundle", "E10_class_measures", "E14_roc_auc", "E16_threshold_sweep",
    "M2_median_impute", "M4_hot_deck", "B1_stratified_split", "B4_stratified_folds", "B8_smote", "L3_forest", "L6_logistic", "L11_top_classes",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    names = tuple(REGISTRY) if only == "all" else tuple(only.split(",")) if only else HEADLINE
    spark = build_session(
        "waymark-bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("plan_session_features", "A3_mean_sum_count"):  # warm the session up
        run(spark, name, folder)
    seconds = {}
    for name in names:
        seconds[name] = round(run(spark, name, folder), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
