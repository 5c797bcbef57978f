"""Benchmark: seconds per headline query, printed as one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated choice. Every result is computed in full and thrown away by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from panelspark.queries import registered
from panelspark.session import local_session

HEADLINE = (
    "csv_scan", "json_pages", "upsert_latest", "hourly_grid", "gap_fill", "anomaly_flags", "clean_p95_cap", "lags",
    "rolling_anchored", "momentum", "grid_features", "net_interchange", "interchange_vol", "fuel_mix", "temp_windows",
    "temp_weighted", "holiday_distance", "regional_demand", "neighbor_stats", "stress_flags", "fcst_error",
    "walk_forward_scores", "win_rate", "quality_audit", "corr_importance", "ridge_scores", "feature_matrix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not measured
    queries, seconds = registered(), {}
    for name in chosen:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
