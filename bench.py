"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is
built and run to the end of its result once, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tillroll.plans.queries import QUERIES
from tillroll.session import STATIC_SETTINGS

HEADLINE = [
    "verify_orders", "accepted_fanout", "order_ids", "new_orders", "order_lines", "order_summary",
    "stock_levels", "remote_stock", "view_stock", "stock_level", "stock_level_sql", "fifo_deliveries", "deliveries",
    "pending_orders", "middle_customer", "payments", "payment_result", "balances", "credit_data", "order_status",
    "merge_results", "modification_log", "dedup_log", "compact_log", "json_decode", "txn_status", "duration_stats",
    "updated_customers", "sql_order_lines", "sql_stock", "check_payment_delta", "gen_stock", "gen_orders",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    for key, value in STATIC_SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["order_ids"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
