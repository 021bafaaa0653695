"""The thirteen export tables and their star relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.functions.numbers import big, cents_per, dbl, pct
from martlet.operators import cohorts, customers, forecasting, metrics, rfm, series
from martlet.operators.clusters import with_clusters
from martlet.plans.star import fact_order_items, fact_orders
from martlet.sources.market import Market

# The features that risk tiers, deciles and scores are made of.
SPEND = ("recency", "frequency", "monetary", "is_repeat")
LOW_VOLUME = "Low volume (<{} units)"


def segmented_customers(orders: DataFrame, items: DataFrame, defs: Definitions, columns: Sequence[str] | None = None) -> DataFrame:
    """Features, risk tier, value decile, RFM scores and segment of every person.

    The thresholds and edges read the features several times over, so the person-grain frame is
    persisted (memory, then disk; rebuilt from lineage when an executor is lost). ``columns`` names the features a job reads
    (the thresholds read those of ``SPEND``): what the others need of lines, reviews and deliveries is not computed then.
    """
    features = customers.customer_features(orders, items, defs)
    if columns is not None:
        features = features.select("customer_unique_id", *dict.fromkeys([*SPEND, *columns]))
    rated = customers.with_value_decile(customers.with_risk(features.persist(), orders, defs))
    return rfm.with_rfm_segment(rfm.with_rfm_scores(rated))


def dim_customers(segmented: DataFrame) -> DataFrame:
    """One row per person, of the features that are there; cluster columns are there when ``with_clusters`` has run."""
    made = {  # column: feature it is made of, expression
        "customer_unique_id": ("customer_unique_id", None), "customer_state": ("state", None),
        "first_order_date": ("first_order", F.to_date("first_order")), "last_order_date": ("last_order", F.to_date("last_order")),
        "recency_days": ("recency", None), "frequency_orders": ("frequency", None), "monetary_revenue": ("monetary", None),
        "avg_order_value": ("monetary", cents_per("monetary", "frequency")), "total_items": ("total_items", None),
        "distinct_categories": ("n_categories", None), "distinct_sellers": ("n_sellers", None), "tenure_days": ("tenure", None),
        "avg_review_score": ("avg_review", F.bround("avg_review", 3)), "late_orders": ("late_orders", None),
        "is_repeat_customer": ("is_repeat", None), "r_score": ("r_score", None), "f_score": ("f_score", None),
        "m_score": ("m_score", None), "rfm_cell": ("rfm_cell", None), "rfm_segment": ("rfm_segment", None),
        "kmeans_cluster": ("cluster", big("cluster")), "kmeans_segment": ("cluster_name", None),
        "value_decile": ("value_decile", None), "risk_tier": ("risk_tier", None)}
    return segmented.select(*[(F.col(feature) if how is None else how).alias(name)
                              for name, (feature, how) in made.items() if feature in segmented.columns])


def dim_category(items: DataFrame, defs: Definitions) -> DataFrame:
    """Category performance with quadrant and momentum; momentum is NULL below its floor."""
    quadrants = metrics.price_volume_quadrants(items, defs.min_units_per_category).select("category", "quadrant")
    moves = metrics.momentum(items, defs).select(
        "category", F.round("revenue_prior", 2).alias(f"revenue_{defs.prior_span.tag}"),
        F.round("revenue_recent", 2).alias(f"revenue_{defs.recent_span.tag}"), F.col("change").alias("momentum_change_brl"),
        F.col("change_pct").alias("momentum_change_pct"))
    cats = metrics.category_performance(items).join(quadrants, "category", "left").join(moves, "category", "left")
    return cats.select(
        "category", F.round("revenue", 2).alias("revenue"), F.col("units_sold").alias("units"), "orders", "products",
        F.round("avg_selling_price", 2).alias("avg_item_price"), F.round("median_price", 4).alias("median_price"),
        F.round("freight", 2).alias("freight"), F.round("revenue_pct", 4).alias("pct_of_revenue"),
        F.round("cum_pct", 4).alias("cumulative_pct_of_revenue"),
        F.coalesce("quadrant", F.lit(LOW_VOLUME.format(defs.min_units_per_category))).alias("quadrant"),
        f"revenue_{defs.prior_span.tag}", f"revenue_{defs.recent_span.tag}", "momentum_change_brl", "momentum_change_pct",
        F.round(pct("freight", "revenue"), 2).alias("freight_pct_of_revenue"))


def dim_product(items: DataFrame) -> DataFrame:
    """Product performance with the rank and running share of every product."""
    ranked = metrics.ranked_by_revenue(metrics.product_performance(items), "product_id")
    return ranked.select(
        "product_id", "category", F.col("units_sold").alias("units"), "orders", dbl("revenue").alias("revenue"),
        cents_per("revenue", "units_sold").alias("avg_item_price"), "min_price", "max_price", F.round("freight", 2).alias("freight"),
        "sellers", "revenue_rank", "cumulative_pct_of_revenue", (F.col("units_sold") == 1).alias("sold_once_only"))


def fact_cohort_retention(orders: DataFrame) -> DataFrame:
    return cohorts.retention_matrix(orders).select(
        "cohort_month", F.col("age").alias("months_since_first_purchase"), "retention_pct", "cohort_size",
        F.col("customers").alias("retained_customers"))


def dim_cohort_summary(orders: DataFrame, defs: Definitions) -> DataFrame:
    return cohorts.cohort_summary(orders, defs.last_month_index)


def fact_revenue_forecast(orders: DataFrame, horizon: int = 3) -> DataFrame:
    """Monthly history and forecast of all revenue as one series."""
    months = series.monthly_series(orders, F.lit("all"))
    return forecasting.history_and_forecast(months, horizon).drop("series_id")


def dim_forecast_models(orders: DataFrame, test: int = 4, holt: bool = True) -> DataFrame:
    months = series.regular(series.monthly_series(orders, F.lit("all")))
    return forecasting.evaluate(series.split_tail(months, test), test, None, holt).drop("series_id")


def dim_seller(items: DataFrame, orders: DataFrame) -> DataFrame:
    ranked = metrics.ranked_by_revenue(
        metrics.seller_service_table(items, orders).withColumn("seller_key", F.col("seller_id")), "seller_key")
    return ranked.select(
        "seller_id", "seller_state", dbl("revenue").alias("revenue"), "items_sold", "orders_n", "products", "avg_item_price",
        "avg_delivery_days", "late_rate_pct", "avg_review_score", "pct_of_revenue", "revenue_rank", "cumulative_pct_of_revenue")


def dim_date(orders: DataFrame, defs: Definitions) -> DataFrame:
    """One row per calendar day of the orders."""
    span = orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select(
        "date", big(F.year("date")).alias("year"), cal.quarter_label("date").alias("quarter"), cal.month_label("date").alias("month"),
        F.date_format("date", "MMM yyyy").alias("month_name"), big(F.dayofmonth("date")).alias("day_of_month"),
        cal.day_name("date").alias("weekday"), big(cal.weekday_number("date")).alias("weekday_number"),
        (cal.weekday_number("date") >= 6).alias("is_weekend"), cal.is_truncated("date", defs.truncation_cutoff).alias("is_truncated_period"))


def build_exports(m: Market, clusters: bool = True) -> dict[str, DataFrame]:
    """All thirteen tables, lazily (the clusters are fitted here when asked for)."""
    orders, items, defs = fact_orders(m), fact_order_items(m), m.defs
    people = segmented_customers(orders, items, defs)
    if clusters:
        people = with_clusters(people)
    return {
        "fact_orders": orders, "fact_order_items": items, "dim_customers_segmented": dim_customers(people),
        "dim_date": dim_date(orders, defs), "dim_product_performance": dim_product(items),
        "dim_category_performance": dim_category(items, defs), "dim_seller_performance": dim_seller(items, orders),
        "dim_region_performance": metrics.region_scorecard(orders), "dim_payment_performance": metrics.payment_mix(orders),
        "fact_cohort_retention": fact_cohort_retention(orders), "dim_cohort_summary": dim_cohort_summary(orders, defs),
        "fact_revenue_forecast": fact_revenue_forecast(orders), "dim_forecast_model_comparison": dim_forecast_models(orders)}


def write_exports(m: Market, directory: str, clusters: bool = True) -> list[dict]:
    """Write every table as Parquet and CSV; facts first, later tables read the written facts."""
    from martlet.sources.storage import export_table

    spark = m.orders.sparkSession
    orders, items = fact_orders(m), fact_order_items(m)
    done = [export_table(orders, directory, "fact_orders"), export_table(items, directory, "fact_order_items")]
    orders = spark.read.parquet(f"{directory}/fact_orders.parquet")
    items = spark.read.parquet(f"{directory}/fact_order_items.parquet")
    people = segmented_customers(orders, items, m.defs)
    rest = {
        "dim_customers_segmented": dim_customers(with_clusters(people) if clusters else people),
        "dim_date": dim_date(orders, m.defs), "dim_product_performance": dim_product(items),
        "dim_category_performance": dim_category(items, m.defs), "dim_seller_performance": dim_seller(items, orders),
        "dim_region_performance": metrics.region_scorecard(orders), "dim_payment_performance": metrics.payment_mix(orders),
        "fact_cohort_retention": fact_cohort_retention(orders), "dim_cohort_summary": dim_cohort_summary(orders, m.defs),
        "fact_revenue_forecast": fact_revenue_forecast(orders), "dim_forecast_model_comparison": dim_forecast_models(orders)}
    return done + [export_table(frame, directory, name) for name, frame in rest.items()]


# Many-to-one relationships (table, column, dimension, column).
RELATIONSHIPS = [
    ("fact_order_items", "order_id", "fact_orders", "order_id"),
    ("fact_orders", "customer_unique_id", "dim_customers_segmented", "customer_unique_id"),
    ("fact_orders", "order_date", "dim_date", "date"),
    ("fact_orders", "customer_state", "dim_region_performance", "customer_state"),
    ("fact_orders", "payment_type", "dim_payment_performance", "payment_type"),
    ("fact_order_items", "product_id", "dim_product_performance", "product_id"),
    ("fact_order_items", "category", "dim_category_performance", "category"),
    ("fact_order_items", "seller_id", "dim_seller_performance", "seller_id"),
    ("fact_cohort_retention", "cohort_month", "dim_cohort_summary", "cohort_month"),
]


def star_join(tables: dict[str, DataFrame], fact: str) -> DataFrame:
    """A fact left-joined to its dimensions; dimension columns get the dimension name as prefix."""
    out = tables[fact]
    for left, left_key, dim, key in RELATIONSHIPS:
        if left != fact or dim not in tables:
            continue
        side = tables[dim].select(*[F.col(c).alias(f"{dim}__{c}") for c in tables[dim].columns])
        out = out.join(side, F.col(left_key) == F.col(f"{dim}__{key}"), "left")
    return out


def check_relationships(tables: dict[str, DataFrame]) -> DataFrame:
    """Fact rows without a dimension row, per relationship (NULL keys are no reference); every table must be there."""
    from martlet.operators.quality import orphans

    missing = sorted({name for t, _, d, _ in RELATIONSHIPS for name in (t, d)} - set(tables))
    if missing:
        raise ValueError(f"relationships need the tables {', '.join(missing)}")
    return orphans({f"{t}[{c}] -> {d}[{k}]": (tables[t], c, tables[d], k) for t, c, d, k in RELATIONSHIPS})
