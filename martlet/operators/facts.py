"""The item fact and the order fact, and the cleaning pipeline that ends in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions.numbers import ratio
from martlet.operators import cleaning
from martlet.operators.views import realised
from martlet.sources.market import FIELDS, TABLE_NAMES, Market

# Columns carried onto the facts.
ITEM_ORDER_COLUMNS = ["order_id", "customer_id", "order_status", "is_delivered", "in_window",
                      "order_purchase_timestamp", "order_date", "order_year", "order_month",
                      "order_quarter", "order_dow", "delivery_days", "is_late"]
PERSON_COLUMNS = ["customer_id", "customer_unique_id", "customer_city", "customer_state",
                  "customer_zip_code_prefix"]
ITEM_PRODUCT_COLUMNS = ["product_id", "product_category_name", "product_category_name_english",
                        "product_weight_g", "product_volume_cm3", "product_photos_qty"]
SELLER_COLUMNS = ["seller_id", "seller_city", "seller_state"]
#: The most sellers that are broadcast to the item lines (about 50 MB).
FEW_SELLERS = 500_000


def _buyers(m: Market) -> DataFrame:
    """Orders with their customers, the columns that the item fact carries."""
    return m.orders.select(*ITEM_ORDER_COLUMNS).join(m.customers.select(*PERSON_COLUMNS), "customer_id", "left")


def _item_columns(m: Market, lines: DataFrame, sellers: bool) -> DataFrame:
    """The item fact's columns, in their order and under their names, whatever the order of the joins was."""
    keys = ["customer_id", "order_id", "seller_id", "product_id"]
    lines = lines.select(*keys, *[c for columns in (m.items.columns, ITEM_PRODUCT_COLUMNS, SELLER_COLUMNS if sellers else [], ITEM_ORDER_COLUMNS, PERSON_COLUMNS)
                                  for c in columns if c not in keys]).withColumnsRenamed({"price": "revenue", "freight_value": "freight"})
    return lines.withColumn("same_state", F.col("customer_state").eqNullSafe(F.col("seller_state"))) if sellers else lines


def order_items_fact(m: Market, sellers: bool = True) -> DataFrame:
    """One row per item line; left joins only, so no line is lost.

    No line is dropped, so lines are dealt while they are narrow: by product, then by order, where the many columns of the order
    and its customer join them and are dealt no more. Up to FEW_SELLERS sellers, counted, are broadcast to the finished lines;
    with more, lines are dealt by seller before all else. ``sellers=False`` leaves out the sellers' columns.
    """
    known = m.sellers.select(*SELLER_COLUMNS) if sellers else None
    few = sellers and known.limit(FEW_SELLERS + 1).count() <= FEW_SELLERS
    lines = m.items.join(known, "seller_id", "left") if sellers and not few else m.items
    lines = lines.join(m.products.select(*ITEM_PRODUCT_COLUMNS), "product_id", "left").join(_buyers(m), "order_id", "left")
    if few:
        lines = lines.join(F.broadcast(known), "seller_id", "left")
    return _item_columns(m, lines, sellers)


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Valid payments per order; the dominant type carries the most value, the earliest on a tie."""
    weight = F.struct(F.col("payment_value"), -F.col("payment_sequential"))
    return payments.where("is_valid_payment").groupBy("order_id").agg(
        F.sum("payment_value").cast("decimal(18,2)").alias("payment_total"), F.count("payment_sequential").alias("n_payment_records"),
        F.max("payment_installments").alias("max_installments"),
        F.max_by("payment_type", weight).alias("payment_type"),
        F.max_by("payment_installments", weight).alias("dominant_installments"))


def item_rollup(items: DataFrame) -> DataFrame:
    """Item sums per order, in one combinable aggregation."""
    return items.groupBy("order_id").agg(
        F.sum("price").cast("decimal(18,2)").alias("order_revenue"),
        F.sum("freight_value").cast("decimal(18,2)").alias("order_freight"),
        F.count("order_item_id").alias("n_items"), F.max("price").alias("max_item_price"))


def item_breadth(items: DataFrame) -> DataFrame:
    """Distinct products and sellers per order.

    Apart from the sums, so that jobs which do not read these columns skip the whole branch: it is
    joined on a unique key, and the optimizer drops such a join when nothing of it is used.
    """
    return items.groupBy("order_id").agg(
        F.countDistinct("product_id").alias("n_distinct_products"), F.countDistinct("seller_id").alias("n_sellers"))


def orders_fact(m: Market) -> DataFrame:
    """One row per order; orders without lines are kept with zero revenue."""
    money_zero = ["order_revenue", "order_freight", "n_items", "n_distinct_products", "n_sellers"]
    wide = (m.orders
            .join(item_rollup(m.items), "order_id", "left")
            .join(item_breadth(m.items), "order_id", "left")
            .join(payment_rollup(m.payments).drop("dominant_installments"), "order_id", "left")
            .join(m.reviews.select("order_id", "review_score", "has_comment", "response_days"), "order_id", "left")
            .join(m.customers.select(*PERSON_COLUMNS), "customer_id", "left"))
    filled = wide.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(wide.schema[c].dataType) for c in money_zero})
    return filled.withColumns({
        "has_items": F.col("n_items") > 0, "is_multi_item": F.col("n_items") > 1,
        "avg_item_price": ratio("order_revenue", "n_items")})


def base_orders(m: Market) -> DataFrame:
    """Order fact limited to the analysis base."""
    return orders_fact(m).where(realised(m.defs))


def base_items(m: Market, sellers: bool = True) -> DataFrame:
    """Item fact limited to the analysis base.

    Orders meet their customers before the lines, and lines their orders before products and sellers: lines are dealt by order
    first, where the filter of the orders drops them, and never by customer.
    """
    lines = m.items.join(_buyers(m), "order_id", "left").join(m.products.select(*ITEM_PRODUCT_COLUMNS), "product_id", "left")
    if sellers:
        lines = lines.join(m.sellers.select(*SELLER_COLUMNS), "seller_id", "left")
    return _item_columns(m, lines, sellers).where(realised(m.defs))


def clean_market(raw: dict[str, DataFrame], defs: Definitions = Definitions()) -> Market:
    """All per-table cleaning jobs, lazily."""
    return Market({
        "orders": cleaning.clean_orders(raw["orders"], defs),
        "items": cleaning.clean_items(raw["order_items"], defs),
        "customers": cleaning.clean_customers(raw["customers"]),
        "products": cleaning.clean_products(raw["products"], raw["category_translation"], defs),
        "sellers": cleaning.clean_sellers(raw["sellers"]),
        "payments": cleaning.clean_payments(raw["payments"], defs),
        "reviews": cleaning.clean_reviews(raw["reviews"]),
        "geolocation": cleaning.clean_geolocation(raw["geolocation"], defs)}, defs)


def run_pipeline(raw: dict[str, DataFrame], defs: Definitions = Definitions(),
                 out_dir: str | None = None) -> dict[str, DataFrame]:
    """Cleaned tables and both facts; written as Parquet when ``out_dir`` is given."""
    from martlet.sources.storage import read_parquet_set, write_parquet_set

    m = clean_market(raw, defs)
    cleaned = {f"{name}_clean": frame for name, frame in m.tables().items()}
    if out_dir is None:
        return cleaned | {"fct_order_items": order_items_fact(m), "fct_orders": orders_fact(m)}
    spark = m.orders.sparkSession
    write_parquet_set(cleaned, out_dir)
    stored = read_parquet_set(spark, out_dir, cleaned)
    again = Market({f: stored[f"{TABLE_NAMES.get(f, f)}_clean"] for f in FIELDS}, defs)
    write_parquet_set({"fct_order_items": order_items_fact(again), "fct_orders": orders_fact(again)}, out_dir)
    return read_parquet_set(spark, out_dir, [*cleaned, "fct_order_items", "fct_orders"])
