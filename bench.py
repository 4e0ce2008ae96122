"""Time the headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur.operators.features import stored
from larkspur.plans import registry
from larkspur.sources.files import clear

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "a01_top_products_revenue",
    "a03_monthly_revenue",
    "a05_customer_ltv",
    "a12_market_basket",
    "a16_cohort_retention",
    "a25_order_cadence",
    "user_product_features",
    "user_category_preferences",
    "product_popularity",
    "product_trend",
    "product_similarity",
    "trending_products",
    "similar_products",
    "recommendations",
    "popularity_baseline",
    "cf_baseline",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = registry.queries()
    took: dict[str, float] = {}
    made[HEADLINE[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    for clock in ("behaviour", "replay"):  # serving and evaluation read a written layer
        start = time.perf_counter()
        stored(getattr(registry, clock)(spark, SF_DIR), anew=True)
        took[f"layer_refresh_{clock}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        made[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    clear(spark)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
