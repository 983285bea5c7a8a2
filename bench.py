"""Time the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_RUNS (timed runs per query; the median counts),
BENCH_QUERIES (comma-separated names), BENCH_DUCKDB (also time the checking SQL, as a yardstick; 0 leaves that out).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runlens.plans import catalog  # noqa: E402
from runlens.session import tune  # noqa: E402

HEADLINE = [
    "e01_reduce_series", "e02_reduce_series_at", "e03_group_mean_std", "e04_folder_ranges", "e10_pivot_table", "e11_marginal_means",
    "e12_curve_mean_std", "e14_describe_values", "e17_step_timing", "e18_cross_corr", "f01_moving_average_4", "f03_resample_linear",
    "f07_topk_admission", "c01_longest_section", "c02_extract_events", "a05_parse_mode_log", "d07_table_diff", "j02_retry_plan",
    "j03_live_leaderboard", "c04_merge_matchers", "e15_value_stats", "a07_scalar_files_all", "j06_live_topk", "k01_ingest_events", "k03_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    folder = tempfile.mkdtemp(prefix="runlens-bench-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("runlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", folder)
    )
    spark = tune(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    con = None
    if os.environ.get("BENCH_DUCKDB", "1") != "0":
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        from oracle_check import connect

        con = connect(sf)

    seconds, yardstick = {}, {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        if con is not None and name in catalog.ORACLE:
            start = time.perf_counter()
            con.execute(catalog.ORACLE[name]).fetchall()
            yardstick[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]} {yardstick.get(name, '')}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)$", sf)
    result = {
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else sf,
    }
    if yardstick:
        result["duckdb"] = yardstick
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
