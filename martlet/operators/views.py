"""The analysis base: realised orders inside the window, and their item lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.sources.market import Market

# Columns of the two base views.
ORDER_COLUMNS = ["order_id", "order_month", "order_quarter", "order_year", "order_date", "order_dow",
                 "delivery_days", "is_late"]
CUSTOMER_COLUMNS = ["customer_id", "customer_unique_id", "customer_state", "customer_city"]


def realised(defs: Definitions) -> Column:
    """The base filter. The window is spelled on the timestamp, so that it reaches the scan."""
    return F.col("is_delivered") & cal.in_dates("order_purchase_timestamp", defs.window_start, defs.window_end)


def analysis_orders(m: Market) -> DataFrame:
    """Delivered orders of the window with their customer."""
    customers = m.customers.select(*CUSTOMER_COLUMNS)
    return (m.orders.where(realised(m.defs))
            .select(*ORDER_COLUMNS, "customer_id").join(customers, "customer_id"))


def _catalogue_lines(m: Market) -> DataFrame:
    """Item lines whose product and seller are known, with category and seller state."""
    products = m.products.select("product_id", F.col("product_category_name_english").alias("category"))
    sellers = m.sellers.select("seller_id", "seller_state")
    lines = m.items.select("order_id", "order_item_id", "product_id", "seller_id",
                           F.col("price").alias("revenue"), "freight_value")
    return lines.join(products, "product_id").join(sellers, "seller_id")


def analysis_items(m: Market) -> DataFrame:
    """Item lines of the analysis orders. Price is called revenue; freight stays apart."""
    return _catalogue_lines(m).join(analysis_orders(m), "order_id")


def order_revenue(m: Market) -> DataFrame:
    """Analysis orders that have lines, with ``revenue``, ``freight`` and ``units``.

    Lines are summed per order *before* the join, so the join is one row to one row and order
    counts need no DISTINCT afterwards.
    """
    per_order = _catalogue_lines(m).groupBy("order_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("freight_value").alias("freight"),
        F.count(F.lit(1)).alias("units"))
    return analysis_orders(m).join(per_order, "order_id")


def customer_value(m: Market, *keys: str) -> DataFrame:
    """Orders, spend and line count per customer (and further order columns)."""
    return order_revenue(m).groupBy("customer_unique_id", *keys).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("spend"), F.sum("units").alias("units"),
        F.min("order_date").alias("first_purchase"), F.max("order_date").alias("last_purchase"))
