"""Named product, category and seller queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.bands import price_band, quadrant
from martlet.functions.numbers import big, dbl, mean, pct, ratio, rounded_pct, scalar, sum_where, total
from martlet.functions.windows import everything
from martlet.operators.views import analysis_items
from martlet.sources.market import Market


def _product_lines(m: Market) -> DataFrame:
    return analysis_items(m).groupBy("product_id", "category").agg(
        F.count(F.lit(1)).alias("units_sold"), F.sum("revenue").alias("revenue"),
        F.min("revenue").alias("low"), F.max("revenue").alias("high"))


def top_products_by_revenue(m: Market, top: int = 20) -> DataFrame:
    """Best products overall and inside their category.

    A product that beats a top product inside its category is itself a top product, so both ranks
    can be taken inside the top rows.
    """
    products = _product_lines(m)
    whole = scalar(products.agg(total("revenue").alias("revenue")), "revenue")["revenue"]
    best = products.orderBy(F.desc("revenue"), "product_id", "category").limit(top)
    return best.select(
        big(F.row_number().over(everything().orderBy(F.desc("revenue"), "product_id", "category"))).alias("overall_rank"),
        big(F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc("revenue")))).alias("rank_in_category"),
        "product_id", "category", "units_sold", dbl("revenue").alias("revenue"),
        F.round(ratio("revenue", "units_sold"), 2).alias("avg_selling_price"),
        dbl("low").alias("min_price"), dbl("high").alias("max_price"),
        F.round(pct("revenue", whole), 3).alias("pct_of_total_revenue")).orderBy("overall_rank")


def worst_performing_products(m: Market, top: int = 15) -> DataFrame:
    """Products sold exactly once, per category."""
    single = _product_lines(m).where(F.col("units_sold") == 1).groupBy("category").agg(
        F.count(F.lit(1)).alias("products_sold_once"), total("revenue").alias("revenue_from_them"),
        F.round(mean("revenue"), 2).alias("avg_price"))
    return single.withColumn(
        "pct_of_all_single_sale_products",
        rounded_pct("products_sold_once", F.sum("products_sold_once").over(everything())),
    ).orderBy(F.desc("products_sold_once"), "category").limit(top)


def category_totals(m: Market) -> DataFrame:
    return analysis_items(m).groupBy("category").agg(
        F.count(F.lit(1)).alias("items_sold"), F.countDistinct("order_id").alias("orders"),
        F.countDistinct("product_id").alias("products"), total("revenue").alias("revenue"))


def category_pareto_80_20(m: Market, top: int = 25) -> DataFrame:
    order = everything().orderBy(F.desc("revenue"), "category")
    running = F.sum("revenue").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("revenue").over(everything())
    ranked = category_totals(m).select(
        big(F.row_number().over(order)).alias("rank"), "category", "products", "items_sold", "revenue",
        rounded_pct("revenue", whole).alias("pct_of_revenue"), rounded_pct(running, whole).alias("cumulative_pct"),
        rounded_pct(F.row_number().over(order), F.count(F.lit(1)).over(everything())).alias("pct_of_categories"))
    side = F.when(F.col("cumulative_pct") <= 80, "within first 80% of revenue").otherwise("tail")
    return ranked.withColumn("pareto_side", side).where(F.col("rank") <= top).orderBy("rank")


# Quadrant labels, (premium, high volume) first.
QUERY_QUADRANTS = {
    (True, True): "premium + high volume (protect)",
    (True, False): "premium + low volume (grow reach)",
    (False, True): "budget + high volume (traffic driver)",
    (False, False): "budget + low volume (review)",
}


def category_price_and_volume_quadrant(m: Market, top: int = 25) -> DataFrame:
    """Categories against the median category price and volume."""
    cats = analysis_items(m).groupBy("category").agg(
        F.count(F.lit(1)).alias("units"), total("revenue").alias("revenue"),
        F.round(mean("revenue"), 2).alias("avg_price")).where(F.col("units") >= m.defs.min_units_per_category)
    placed = cats.withColumns({"mid_price": F.median("avg_price").over(everything()),
                               "mid_units": F.median("units").over(everything())})
    label = quadrant(F.col("avg_price") >= F.col("mid_price"), F.col("units") >= F.col("mid_units"), QUERY_QUADRANTS)
    return placed.select(
        "category", "units", "revenue", "avg_price", F.round("mid_price", 2).alias("median_category_price"),
        F.round("mid_units", 0).alias("median_category_units"), label.alias("quadrant"),
    ).orderBy(F.desc("revenue"), "category").limit(top)


def price_band_analysis(m: Market) -> DataFrame:
    band = price_band("revenue", m.defs.price_edges, m.defs.currency)
    bands = analysis_items(m).groupBy(band.alias("price_band")).agg(
        F.count(F.lit(1)).alias("item_lines"), total("revenue").alias("revenue"),
        F.round(mean("revenue"), 2).alias("avg_price"))
    return bands.select(
        "price_band", "item_lines", rounded_pct("item_lines", F.sum("item_lines").over(everything())).alias("pct_of_lines"),
        "revenue", rounded_pct("revenue", F.sum("revenue").over(everything())).alias("pct_of_revenue"), "avg_price",
    ).orderBy("price_band")


def category_monthly_momentum(m: Market) -> DataFrame:
    """Last three months of the window against the three before, for categories of some size."""
    recent, prior = m.defs.recent_span, m.defs.prior_span
    cats = analysis_items(m).groupBy("category").agg(
        sum_where(F.col("order_month").isin(*recent.months), "revenue").alias("now"),
        sum_where(F.col("order_month").isin(*prior.months), "revenue").alias("then"))
    kept = cats.where(F.col("then") > m.defs.momentum_floor)
    change = F.col("now") - F.col("then")
    return kept.select(
        "category", F.col("then").alias(f"revenue_{prior.tag}"), F.col("now").alias(f"revenue_{recent.tag}"),
        F.round(change, 2).alias("change_brl"), rounded_pct(change, "then").alias("change_pct"),
        big(F.rank().over(everything().orderBy(F.round(change, 2).desc()))).alias("momentum_rank"),
    ).orderBy(F.desc("change_brl"), "category")


def seller_concentration(m: Market, top: int = 20) -> DataFrame:
    """Largest sellers and the running share of revenue they hold."""
    sellers = analysis_items(m).groupBy("seller_id", "seller_state").agg(
        F.countDistinct("order_id").alias("orders"), F.count(F.lit(1)).alias("items"),
        F.countDistinct("product_id").alias("products"), total("revenue").alias("revenue"))
    whole = scalar(sellers.agg(F.sum("revenue").alias("revenue")), "revenue")["revenue"]
    best = sellers.orderBy(F.desc("revenue"), "seller_id", "seller_state").limit(top)
    order = everything().orderBy(F.desc("revenue"), "seller_id", "seller_state")
    running = F.sum("revenue").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return best.select(
        big(F.row_number().over(order)).alias("seller_rank"), "seller_id", "seller_state", "orders", "items",
        "products", "revenue", rounded_pct("revenue", whole, 3).alias("pct_of_revenue"),
        rounded_pct(running, whole).alias("cumulative_pct")).orderBy("seller_rank")


PRODUCT_QUERIES = {f.__name__: f for f in (
    top_products_by_revenue, worst_performing_products, category_pareto_80_20,
    category_price_and_volume_quadrant, price_band_analysis, category_monthly_momentum,
    seller_concentration)}
