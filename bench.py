"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``. Each
query is planned, run to the end and its rows are thrown away; the better of two runs
counts, as the first one also compiles code.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from lodestar.queries import QUERIES
from lodestar.sources.staging import release_staged

HEADLINE = (
    "rolling_distinct_28d",
    "rolling_distinct_month_end",
    "rolling_distinct_bridge",
    "running_total_adjusted",
    "sumx_related",
    "cumulative_to_incremental",
    "add_index",
    "surrogate_key_grouped",
    "scd_surrogate_lookup",
    "join_expand_checked",
    "join_expand_dedup",
    "replace_with_default",
    "ti_all_variants",
    "historical_member_fact",
    "column_statistics",
    "cascade_match",
    "spike_query_log",
    "unused_measures",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    release_staged(spark)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, better of two runs each, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
