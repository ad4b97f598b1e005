"""Time the warehouse build and the analyses; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
The raw CSV file is prepared first and not timed. Layers are then built from it once and timed as
build_*; analyses run on the gold tables. Every result is computed in full (noop sink).
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallyhouse.catalogue import QUERIES
from tallyhouse.plans.warehouse import Warehouse
from tallyhouse.sources.order_feed import order_feed
from tallyhouse.sources.raw_csv import write_raw
from tallyhouse.sources.shared import SharedFolder

BUILDS = (
    "bronze", "silver", "dim_customer", "dim_product", "dim_geography", "dim_date", "fact_sales",
)
ANALYSES = (
    "kpi_summary", "region_performance", "category_performance", "segment_performance", "yoy_growth",
    "cagr", "peak_season", "customer_frequency_tiers", "top_pct_customers",
    "running_total_by_category", "pareto_customers", "pareto_products", "yoy_churn",
    "segment_margin_yoy", "rfm", "rfm_corrected", "subcategory_profitability",
    "check_foreign_keys", "reconcile_totals", "profile_silver", "duplicate_preview",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyhouse-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # The input is one small file per table: small row groups and few broadcasts let all cores
        # take part. On a cluster the defaults are right.
        .config("spark.hadoop.parquet.block.size", str(4 << 20))
        .config("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared = SharedFolder.of(spark)
    raw_file = shared.fresh("raw")
    write_raw(order_feed(spark, folder), raw_file)
    house = Warehouse.from_csv(spark, raw_file, shared.root)

    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)

    for layer in BUILDS:
        timed(f"build_{layer}", lambda: house[layer])
    for name in ANALYSES:
        timed(name, lambda: QUERIES[name](house).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "retail_warehouse_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
