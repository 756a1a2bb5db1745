"""Timed run of the headline queries; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the mean counts.
All rows and columns are computed, into Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sparkcols.plans.registry import queries
from sparkcols.session import build_session
from sparkcols.sources.sinks import sink_noop

HEADLINE = [
    # columns and group-bys
    "ingest", "col_sum", "col_multiply", "filter_gt", "sort_desc", "count_distinct", "group_sum", "group_count",
    "group_multi", "group_multikey_sum", "group_highcard_sum",
    # text, plain and encoded
    "count_eq", "group_count_text", "distinct_values", "count_in", "top_asc", "count_like",
    "dict_encode", "dict_filter_count", "dict_group_count", "encoding_report",
    # keys
    "point_lookup_long", "range_count_long", "top_desc_long", "page_long", "multi_lookup_long", "group_near_unique",
    "join_count_tables", "join_count_large", "timed_id", "uuid_v7",
    # reports
    "mean_after_warmup", "fastest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            sink_noop(registered[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(sum(times[1:]) / runs, 4)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
