"""Runs the headline queries and prints one line of JSON.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; each query runs twice and
its better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from grovekit.plans.catalog import QUERIES

HEADLINE = (
    "msf_edges", "msf_forest", "msf_price", "filter_edges", "kruskal_edges", "msf_rounds_only", "components", "msf_summary", "round1_candidates", "contract_once", "verify_row",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            times[name] = round(min(took, times.get(name, took)), 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
