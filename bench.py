"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from emulake.plans import catalog
from emulake.session import build_session

HEADLINE = [
    "flagship_linear_surrogate", "t1_split_shuffled", "t3_kfold", "t5_split_stratified", "t6_standardize", "s17_batches",
    "a1_split_metrics", "a7_describe", "a11_validate", "a13_correlations", "a17_density_2d", "a34_r2_grid", "j5_compare_models",
    "p1_column_catalogue", "a22_drift_policy", "e3_block_evaluation", "w1_best_so_far", "w2_patience", "w5_chunk_plan", "g5_verify_set",
    "s9_case_catalogue", "x11_mode_rows", "m10_batch_scoring", "m1_random_forest", "m2_mlp", "m3_fourier_bayes", "e1_workflow",
    "r2_watch_blocks_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    seconds: dict[str, float] = {}
    for name in names:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
