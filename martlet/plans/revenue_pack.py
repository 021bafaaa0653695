"""Named revenue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.numbers import big, growth_pct, mean, ratio, rounded_pct, total
from martlet.functions.windows import everything
from martlet.operators.views import analysis_items, order_revenue
from martlet.sources.market import Market


def _by_period(m: Market, *keys: str) -> DataFrame:
    return order_revenue(m).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_unique_id").alias("customers"),
        total("revenue").alias("revenue"))


def monthly_revenue_and_growth(m: Market) -> DataFrame:
    """Orders, customers, revenue, AOV, month-on-month growth, moving average, running total."""
    order = everything().orderBy("order_month")
    before = F.lag("revenue").over(order)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return _by_period(m, "order_month").select(
        "order_month", "orders", "customers", "revenue",
        F.round(ratio("revenue", "orders"), 2).alias("aov"),
        before.alias("prev_month_revenue"),
        F.round(growth_pct("revenue", before), 2).alias("mom_growth_pct"),
        F.round(F.avg("revenue").over(order.rowsBetween(-2, 0)), 2).alias("revenue_3mo_moving_avg"),
        F.round(F.sum("revenue").over(so_far), 2).alias("cumulative_revenue"),
        rounded_pct("revenue", F.sum("revenue").over(everything())).alias("pct_of_total_revenue"),
    ).orderBy("order_month")


def yoy_growth_comparable_window(m: Market) -> DataFrame:
    """Years compared on the months that all of them cover."""
    same_months = order_revenue(m).where(F.month("order_date") <= m.defs.comparable_months)
    by_year = same_months.groupBy("order_year").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_unique_id").alias("customers"),
        total("revenue").alias("revenue")).withColumn("exact_aov", ratio("revenue", "orders"))
    order = everything().orderBy("order_year")

    def yoy(c: str):
        return F.round(growth_pct(c, F.lag(c).over(order)), 2)

    return by_year.select(
        big("order_year").alias("order_year"), "orders", "customers", "revenue",
        F.round("exact_aov", 2).alias("aov"), yoy("revenue").alias("revenue_yoy_pct"),
        yoy("orders").alias("orders_yoy_pct"), yoy("exact_aov").alias("aov_yoy_pct")).orderBy("order_year")


def quarterly_revenue_with_lead(m: Market) -> DataFrame:
    """Neighbouring quarters, growth, and a label for the quarter the window cuts short."""
    quarters = order_revenue(m).groupBy("order_quarter").agg(
        F.count(F.lit(1)).alias("orders"), total("revenue").alias("revenue"))
    order = everything().orderBy("order_quarter")
    before = F.lag("revenue").over(order)
    label = F.lit("complete")
    if m.defs.partial_quarter:
        quarter, covered = m.defs.partial_quarter
        label = F.when(F.col("order_quarter") == quarter,
                       f"PARTIAL - {covered} only, QoQ not comparable").otherwise("complete")
    return quarters.select(
        "order_quarter", "orders", "revenue", before.alias("prev_quarter"),
        F.lead("revenue").over(order).alias("next_quarter"),
        F.round(growth_pct("revenue", before), 2).alias("qoq_growth_pct"),
        label.alias("data_completeness")).orderBy("order_quarter")


def revenue_contribution_by_category(m: Market, top: int = 20) -> DataFrame:
    """Rank, share, running share and Pareto band per category."""
    cats = analysis_items(m).groupBy("category").agg(
        F.count(F.lit(1)).alias("items_sold"), F.countDistinct("order_id").alias("orders"),
        total("revenue").alias("revenue"), F.round(mean("revenue"), 2).alias("avg_item_price"))
    by_revenue = everything().orderBy(F.desc("revenue"))
    running = everything().orderBy(F.desc("revenue"), "category").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("revenue").over(everything())
    ranked = cats.select(
        big(F.rank().over(by_revenue)).alias("revenue_rank"), "category", "orders", "items_sold", "revenue",
        "avg_item_price", rounded_pct("revenue", whole).alias("pct_of_revenue"),
        F.try_divide(100.0 * F.sum("revenue").over(running), whole).alias("running"))
    band = F.when(F.col("running") <= 50, "top 50% of revenue").when(F.col("running") <= 80, "next 30%")
    return ranked.select(
        *ranked.columns[:-1], F.round("running", 2).alias("cumulative_pct"),
        band.otherwise("long tail").alias("pareto_band")).orderBy(F.desc("revenue"), "category").limit(top)


def revenue_by_region(m: Market, top: int = 15) -> DataFrame:
    """State revenue and order value against the national order value."""
    states = _by_period(m, "customer_state").withColumns({
        "exact_aov": ratio("revenue", "orders"),
        "all_revenue": F.sum("revenue").over(everything()), "all_orders": F.sum("orders").over(everything())})
    national = ratio("all_revenue", "all_orders")
    return states.select(
        big(F.row_number().over(everything().orderBy(F.desc("revenue"), "customer_state"))).alias("revenue_rank"),
        "customer_state", "orders", "customers", "revenue",
        rounded_pct("revenue", "all_revenue").alias("pct_of_revenue"),
        F.round("exact_aov", 2).alias("state_aov"), F.round(national, 2).alias("national_aov"),
        F.round(F.col("exact_aov") - national, 2).alias("aov_vs_national"),
        big(F.dense_rank().over(everything().orderBy(F.desc("exact_aov")))).alias("aov_rank"),
    ).orderBy("revenue_rank").limit(top)


def monthly_revenue_by_top_category(m: Market, top: int = 5) -> DataFrame:
    """Monthly trend of the best categories; ranks come from the monthly aggregate itself."""
    monthly = analysis_items(m).groupBy("category", "order_month").agg(total("revenue").alias("revenue"))
    whole = monthly.groupBy("category").agg(F.round(F.sum("revenue"), 2).alias("whole"))
    best = whole.withColumn("place", F.rank().over(everything().orderBy(F.desc("whole")))).where(F.col("place") <= top)
    order = Window.partitionBy("category").orderBy("order_month")
    before = F.lag("revenue").over(order)
    kept = monthly.where(F.col("order_month") >= m.defs.trend_from_month).join(best, "category", "left_semi")
    return kept.select(
        "category", "order_month", "revenue", before.alias("prev_month"),
        F.round(growth_pct("revenue", before), 2).alias("mom_pct"),
        F.round(F.avg("revenue").over(order.rowsBetween(-2, 0)), 2).alias("moving_avg_3mo"),
    ).orderBy("category", "order_month")


def freight_burden_by_region(m: Market, min_lines: int = 500) -> DataFrame:
    """Freight as a share of revenue per state with enough lines."""
    states = order_revenue(m).groupBy("customer_state").agg(
        F.sum("units").alias("item_lines"), total("revenue").alias("revenue"), total("freight").alias("freight"))
    kept = states.where(F.col("item_lines") >= min_lines)
    burden = ratio("freight", "revenue")
    return kept.select(
        "customer_state", "item_lines", "revenue", "freight",
        rounded_pct("freight", "revenue").alias("freight_pct_of_revenue"),
        F.round(ratio("freight", "item_lines"), 2).alias("avg_freight_per_item"),
        big(F.rank().over(everything().orderBy(burden.desc()))).alias("freight_burden_rank"),
    ).orderBy(F.desc("freight_pct_of_revenue"), "customer_state")


REVENUE_QUERIES = {f.__name__: f for f in (
    monthly_revenue_and_growth, yoy_growth_comparable_window, quarterly_revenue_with_lead,
    revenue_contribution_by_category, revenue_by_region, monthly_revenue_by_top_category,
    freight_burden_by_region)}
