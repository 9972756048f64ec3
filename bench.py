"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables and BENCH_CPUS the
number of local threads. Each query runs once to warm up and then BENCH_RUNS
times; the median is reported. Results are consumed whole (no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from frostline.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "device_day_risk",
    "decisions",
    "all_features",
    "timing_features",
    "gps_features",
    "sensor_features",
    "smoothed_features",
    "kinematic_features",
    "replay_features",
    "decisions_long_series",
    "validation_split",
    "posture_update",
    "posture_from_findings",
    "telemetry_with_posture",
    "filled_time_bins",
    "hourly_labels_long",
    "pr_curve",
    "curve_areas",
    "operational_report",
    "isolation_forest",
    "risk_fusion",
    "attack_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("frostline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="frostline-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        # a feature plan compiles more classes than the default cache holds
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # the tables are small here: keep every core busy
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": rows,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
