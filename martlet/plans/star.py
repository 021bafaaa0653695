"""Star schema fact tables in export form; the metric jobs read these columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions.calendar import is_truncated
from martlet.functions.numbers import big, cents_per
from martlet.operators.facts import base_items, base_orders
from martlet.sources.market import Market


def fact_orders(m: Market) -> DataFrame:
    """One row per delivered order in the window."""
    return base_orders(m).select(
        "order_id", "customer_unique_id", "order_date", F.col("order_purchase_timestamp").alias("order_timestamp"),
        big("order_year").alias("order_year"), "order_month", "order_quarter", F.col("order_dow").alias("order_weekday"),
        big("order_hour").alias("order_hour"), F.col("order_revenue").alias("revenue"),
        F.col("order_freight").alias("freight"), big("n_items").alias("items_in_order"),
        big("n_distinct_products").alias("distinct_products"), big("n_sellers").alias("distinct_sellers"),
        cents_per("order_revenue", "n_items").alias("avg_item_price"), "is_multi_item", "payment_type",
        big("max_installments").alias("max_installments"), big("review_score").alias("review_score"),
        F.bround("delivery_days", 2).alias("delivery_days"), F.bround("estimated_days", 2).alias("estimated_days"),
        F.bround("delivery_vs_estimate_days", 2).alias("delivery_vs_estimate_days"), "is_late", "customer_state",
        "customer_city", is_truncated("order_date", m.defs.truncation_cutoff).alias("is_truncated_period"))


def fact_order_items(m: Market, sellers: bool = True) -> DataFrame:
    """One row per product line of those orders, with the order columns the item filters use.

    ``sellers=False`` leaves out what is known of the seller beyond its id, for jobs that do not read it.
    """
    place = ["seller_state", F.col("same_state").alias("same_state_delivery")] if sellers else []
    return base_items(m, sellers).select(
        "order_id", big("order_item_id").alias("order_item_id"), "product_id", "seller_id", "customer_unique_id",
        "order_date", "order_month", "order_quarter", F.col("product_category_name_english").alias("category"),
        "revenue", "freight", "customer_state", *place,
        big("order_year").alias("order_year"), F.col("order_purchase_timestamp").alias("order_timestamp"))


def items_with_payment(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Item lines with their order's payment type, for the payment filter."""
    return items.join(orders.select("order_id", "payment_type"), "order_id", "left")
