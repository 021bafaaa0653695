"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose data and
parallelism. Each query runs once to warm up code generation, then once for the clock; cached
frames are dropped in between, so every timed run reads the files.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from martlet.plans.registry import all_queries

HEADLINE = [
    "monthly_revenue_and_growth", "yoy_growth_comparable_window", "revenue_contribution_by_category", "revenue_by_region",
    "monthly_revenue_by_top_category", "top_customers_ranked", "customer_rfm_scores", "revenue_concentration_by_customer_decile",
    "new_vs_returning_by_month", "top_products_by_revenue", "category_pareto_80_20", "seller_concentration",
    "payment_method_performance", "regional_performance_scorecard", "seller_performance_proxy", "delivery_experience_vs_repeat",
    "kpis", "product_pareto", "retention_curve", "test_welch_payment_value", "test_mann_whitney", "series_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
