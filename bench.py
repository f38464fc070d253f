"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.
Every query runs once, after one small query that starts the session, and its
whole result is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "item_grid_median", "wide_grid_median", "load_concepts_wide", "load_sofa", "load_sepsis3", "sofa_over_time", "gap_free_grid",
    "gap_free_grid_carried", "slide_look_back", "carry_forward", "carry_within_a_day", "sessions_by_gap", "merged_ranges",
    "expanded_windows", "last_before", "nearest_within_tolerance", "window_aggregates_closed", "infection_by_both",
    "sepsis_first_infection", "kidney_injury_stages", "circulatory_failure_windows", "merge_concepts_wide", "charted_rates_by_minute",
    "exact_quantiles", "table_one", "quality_report", "bucketed_round_trip", "warning_scores",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from checks import QUERIES
    from staygrid.session import SETTINGS

    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
