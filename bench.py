"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each
query runs once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tankline.plans.registry import QUERIES
from tankline.session import tuned

HEADLINE = [
    "preprocess", "preprocess_standard", "preprocess_sliced", "detect_leaks", "detect_leaks_fanout",
    "drains_per_day", "time_gap", "fuel_diff", "daily_leak_count", "daily_leak_sum", "car_leak_count",
    "car_leak_volume", "metrics_mean", "metrics_median", "norms_pivot", "car_upsert", "metrics_upsert",
    "duplicate_uploads", "pending_uploads", "entity_page", "entity_search", "nested_report", "driver_cars",
    "csv_roundtrip", "upload_reports", "stream_intake",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    builder = (
        tuned(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
