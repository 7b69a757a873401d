"""Time the headline queries on one machine: one JSON line with seconds per query.

Each query runs once to warm up, then three times; the median counts. Results are computed in full and dropped.
"""

import json
import os
import statistics
import sys
import time

from tallyspark.queries import QUERIES, inputs
from tallyspark.session import local_session, new_folder
from tallyspark.sources import store

HEADLINES = (
    "p5_wechat_formula_facts", "g1_month_sku_rollup", "p2_xiaohongshu_facts", "w1_w2_line_numbers", "w4_freight_spread",
    "j1_xiaohongshu_settlements", "j2_douyin_finance", "j4_merge_stats", "j5_w5_effective_rows", "u2_merge_upsert",
    "g10_duplicate_merge", "s3_partition_scan", "o1_fact_page", "p10_search_three_columns", "g6_fact_summary",
    "k5_fact_export", "k4_csv_export", "g15_operations_per_minute",
)
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def seconds(spark, run, sf_dir):
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    inputs.rollup_root(spark, sf_dir)  # facts and roll-up tables that the views read; also the warm-up of the next
    start = time.perf_counter()
    store.write_facts(inputs.wechat_facts(spark, sf_dir), new_folder(spark, "facts"))
    timings = {"write_facts": round(time.perf_counter() - start, 3)}
    print(f"write_facts {timings['write_facts']}", file=sys.stderr, flush=True)
    for name in HEADLINES:
        seconds(spark, QUERIES[name], sf_dir)
        runs = [seconds(spark, QUERIES[name], sf_dir) for _ in range(REPEATS)]
        timings[name] = round(statistics.median(runs), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": cores, "spark": spark.version,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
