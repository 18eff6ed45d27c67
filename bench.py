"""Seconds per headline query: one warm-up, then the median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tonegauge.catalog import QUERIES
from tonegauge.session import build_session

HEADLINE = [
    "h3_filled_index", "h4_common_end", "h5_calendar_grid", "g1_daily_mean", "g2_diffusion_index", "g7_month_crosstab",
    "g10_grouped_describe", "g12_category_share", "g15_score_distribution", "g16_request_statistics", "g17_index_summary",
    "b6_sequential_id", "f1_positional_join", "f2_key_join", "h6_token_chunks", "h7_latest_state", "g19_status_rollup",
    "c2_serialized_tokens", "c9_full_audit", "d1_lenient_parse", "e7_row_errors", "e9_error_histogram", "i4_extreme_pick",
    "i5_middle_sample", "k1_scored_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
