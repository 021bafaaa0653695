"""Commerce tables derived from the generic sample star schema.

The sample has no payments, reviews, approval times or translations; they are stood in for by
integer and decimal expressions over its rows, so they grow with the data and mean the same in any
SQL engine. They exercise operators and carry no business meaning.
"""

from __future__ import annotations

from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions.numbers import money
from martlet.operators import cleaning
from martlet.sources.market import Market

SAMPLE_DEFINITIONS = Definitions(
    realised_statuses=("F",),
    window_start=date(1996, 1, 1),
    window_end=date(2001, 7, 31),
    truncation_cutoff=date(2001, 7, 23),
    shipping_limit_from=date(1995, 6, 1),
    shipping_limit_to=date(2001, 6, 30),
    min_orders_per_state=100,
    min_units_per_category=500,
    min_freight_units=500,
    price_edges=(1000, 5000, 20000, 40000, 60000, 90000),
    trend_from_month="2001-02",
    manual_translations={"Brand#7": "brand_7"},
)


# Declared schemas, so that building a plan reads no file footers.
SAMPLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shipped = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
               .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")))
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return o.join(shipped, key == F.col("l_orderkey"), "left").select(
        key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        day.alias("order_purchase_timestamp"),
        F.when(key % 211 != 0, F.timestamp_add("HOUR", (key % 72).cast("int"), day))
        .alias("order_approved_at"),
        F.col("first_ship").alias("order_delivered_carrier_date"),
        F.col("last_ship").alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(30), day).alias("order_estimated_delivery_date"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.col("l_tax").cast("decimal(4,2)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        money("l_extendedprice").alias("price"),
        money(money("l_extendedprice") * tax).alias("freight_value"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
        (F.col("c_custkey") % 100).alias("customer_zip_code_prefix"),
        F.concat(F.lit(" "), F.lower("c_name"), F.lit("--"), F.col("c_mktsegment")).alias("customer_city"),
        F.concat(F.lower("n_name"), F.lit(" ")).alias("customer_state"))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.when(key % 53 != 0, F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").cast("double").alias("product_name_lenght"),
        (key % 1000).cast("double").alias("product_description_lenght"),
        (key % 6).cast("double").alias("product_photos_qty"),
        F.when(key % 97 == 0, 0).otherwise(size * 100).cast("double").alias("product_weight_g"),
        F.when(key % 89 != 0, key % 50 + 10).cast("double").alias("product_length_cm"),
        (size + 5).cast("double").alias("product_height_cm"),
        (key % 40 + 8).cast("double").alias("product_width_cm"))


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One English name per brand; two brands are left out."""
    return (table(spark, sf_dir, "part").select("p_brand").distinct()
            .where(~F.col("p_brand").isin("Brand#7", "Brand#13"))
            .select(F.col("p_brand").alias("product_category_name"),
                    F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
                    .alias("product_category_name_english")))


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"), (F.col("s_suppkey") % 120).alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"), F.col("n_name").alias("seller_state"))


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per order, and a second voucher payment on every fourth order."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = money("o_totalprice")
    voucher = F.when(key % 40 == 0, 0).otherwise(key % 1000 * 100).cast("decimal(18,2)")
    method = (F.when(key % 500 == 3, "not_defined")
              .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "credit_card")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "boleto")
              .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "debit_card")
              .otherwise(" voucher "))
    main = o.select(key.alias("order_id"), F.lit(1).alias("payment_sequential"),
                    method.alias("payment_type"),
                    F.when(key % 250 == 7, 0).otherwise(key % 12 + 1).cast("int").alias("payment_installments"),
                    F.when(key % 500 == 3, 0).otherwise(value).cast("decimal(18,2)").alias("payment_value"))
    second = o.where(key % 4 == 0).select(
        key.alias("order_id"), F.lit(2).alias("payment_sequential"), F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"), voucher.alias("payment_value"))
    return main.unionByName(second)


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review on most orders, and a later or unanswered second one on every fiftieth."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    created = F.timestamp_add("DAY", F.lit(10), F.col("o_orderdate"))
    score = (key * 7 + F.col("o_custkey")) % 5 + 1
    message = F.when(key % 3 != 0, F.concat(F.lit("order "), key.cast("string")))
    first = o.where(key % 125 != 0).select(
        key.alias("review_id"), key.alias("order_id"), score.cast("int").alias("review_score"),
        F.when(key % 10 == 0, "title").alias("review_comment_title"), message.alias("review_comment_message"),
        created.alias("review_creation_date"),
        F.timestamp_add("HOUR", (key % 48 + 24).cast("int"), created).alias("review_answer_timestamp"))
    second = o.where(key % 50 == 1).select(
        (key - key % 3).alias("review_id"), key.alias("order_id"),
        ((score + key) % 5 + 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"), message.alias("review_comment_message"),
        created.alias("review_creation_date"),
        F.when(key % 100 != 1, F.timestamp_add("HOUR", F.lit(96), created)).alias("review_answer_timestamp"))
    return first.unionByName(second)


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point observations: one per customer, some outside the bounding box."""
    c, n, key = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), F.col("c_custkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (key % 110).alias("geolocation_zip_code_prefix"),
        ((key * 37 % 4500 - 3500) / F.lit(100.0)).alias("geolocation_lat"),
        ((key * 53 % 4000 - 7400) / F.lit(100.0)).alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"), F.col("n_name").alias("geolocation_state"))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"orders": raw_orders(spark, sf_dir), "order_items": raw_items(spark, sf_dir),
            "customers": raw_customers(spark, sf_dir), "products": raw_products(spark, sf_dir),
            "payments": raw_payments(spark, sf_dir), "reviews": raw_reviews(spark, sf_dir),
            "sellers": raw_sellers(spark, sf_dir), "geolocation": raw_geolocation(spark, sf_dir),
            "category_translation": translation(spark, sf_dir)}


@lru_cache(maxsize=4)
def sample_market(spark: SparkSession, sf_dir: str) -> Market:
    """The sample as a market; planned once per session and directory."""
    defs = SAMPLE_DEFINITIONS
    return Market({
        "orders": lambda: cleaning.clean_orders(raw_orders(spark, sf_dir), defs),
        "items": lambda: cleaning.clean_items(raw_items(spark, sf_dir), defs),
        "customers": lambda: cleaning.clean_customers(raw_customers(spark, sf_dir)),
        "products": lambda: cleaning.clean_products(raw_products(spark, sf_dir), translation(spark, sf_dir), defs),
        "sellers": lambda: cleaning.clean_sellers(raw_sellers(spark, sf_dir)),
        "payments": lambda: cleaning.clean_payments(raw_payments(spark, sf_dir), defs),
        "reviews": lambda: cleaning.clean_reviews(raw_reviews(spark, sf_dir)),
    }, defs)
