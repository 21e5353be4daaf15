"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores of the local session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = [
    "c14_c15_failure_history",
    "c13_previous_run",
    "c03_total_builds",
    "c17_committer_counts",
    "c18_committer_standing",
    "b5_repository_experience",
    "c16_hotspot_files",
    "d07_hotspot_touched",
    "c19_same_files_as_previous",
    "c20_commit_metrics",
    "c22_pull_request",
    "c12_test_totals",
    "d02_d08_diff_stats",
    "d09_d10_symbol_diff",
    "d11_dependency_changes",
    "e04_error_reason",
    "log_facts",
    "e05_previous_jobs",
    "e06_e08_changes_since_previous",
    "a07_merged_features",
    "a09_merged_history",
    "job_features",
    "c29_run_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("runlore-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from contract import CASES
    from runlore.session import configure

    configure(spark)

    only = sys.argv[1:]
    names = [n for n in HEADLINES if not only or n in only]
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the timings
    seconds = {}
    for name in names:
        began = time.perf_counter()
        CASES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
