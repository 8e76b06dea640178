"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no rows are collected to the
driver). Prints one JSON line: total seconds and seconds per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lathe import registry  # noqa: E402
from lathe.session import local_session  # noqa: E402

HEADLINE = [
    # profiling the widest and longest tables
    "column_profile", "numeric_stats", "analysis_report", "missing_values", "duplicate_rows", "sample_values",
    "dataset_context", "column_actions",
    # splits and folds with exact sizes
    "split_random", "split_stratified", "split_time", "kfold", "kfold_stratified",
    # fitted preprocessing, engineering and selection
    "prep_chain", "impute_median", "scale_robust", "one_hot", "fe_chain", "fs_correlation", "fs_mutual_info",
    # metrics over prediction tables
    "confusion_matrix", "metric_prf_macro", "metric_roc_auc", "metric_roc_auc_ovr", "metric_regression", "leaderboard",
    # models and a whole run
    "linreg_fit", "knn_classify", "auto_train",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="lathe-bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").collect()  # start-up, not timed
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in qs]
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
