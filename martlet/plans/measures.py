"""Named measures as aggregate expressions, and page datasets under slicers.

A measure is a function of its context that returns a ``Column`` for ``.agg()``; filters *inside*
a measure are conditional aggregates. Three measures need more than one aggregate frame (an
unfiltered total, the previous month, the first forecast month) and are given as frame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions.numbers import growth_pct, mean, ratio, scalar, total
from martlet.functions.windows import everything
from martlet.operators.metrics import _median


def order_measures(defs: Definitions = Definitions(), one_row_per_order: bool = False) -> dict[str, Column]:
    """Measures of the order fact (the median and month-on-month measures are frame functions).

    Orders are counted distinctly, so the fact may be joined to lines; ``one_row_per_order`` says that it is not, and rows
    are counted in place of ids.
    """
    known = F.col("order_id").isNotNull()

    def _orders_where(cond: Column) -> Column:
        return F.count_if(cond & known) if one_row_per_order else F.countDistinct(F.when(cond, F.col("order_id")))
    revenue, orders = total("revenue"), _orders_where(known)
    card = F.col("payment_type") == defs.instalment_payment
    return {
        "Total Revenue": revenue,
        "Revenue (Trend)": total(F.when(~F.col("is_truncated_period"), F.col("revenue"))),
        "Total Freight": total("freight"),
        "Freight % of Revenue": ratio(F.sum("freight"), F.sum("revenue")),
        "Orders": orders,
        "Customers": F.countDistinct("customer_unique_id"),
        "AOV (Mean)": ratio(F.sum("revenue"), orders),
        "AOV (Credit Card)": ratio(F.sum(F.when(card, F.col("revenue"))), _orders_where(card)),
        "Multi-Item Order %": ratio(_orders_where(F.col("is_multi_item")), orders),
        "Late Rate %": ratio(_orders_where(F.col("is_late")), orders),
        "Avg Delivery Days": F.avg("delivery_days"),
        "Avg Review Score": F.avg("review_score"),
        "One-Star Rate %": ratio(F.count_if(F.col("review_score") == 1), F.count("review_score")),
    }


def item_measures() -> dict[str, Column]:
    return {
        "Item Revenue": total("revenue"), "Items Sold": F.count(F.lit(1)), "Products Sold": F.countDistinct("product_id"),
        "Avg Item Price": ratio(F.sum("revenue"), F.count(F.lit(1)))}


def customer_measures() -> dict[str, Column]:
    """Measures of the customer dimension (the share of all customers' revenue is a frame function)."""
    n, repeat = F.count(F.lit(1)), F.count_if("is_repeat_customer")
    return {"Segment Customers": n, "Segment Revenue": total("monetary_revenue"), "Repeat Customers": repeat,
            "Repeat Rate %": ratio(repeat, n), "Avg Customer Value": mean("monetary_revenue")}


def retention_measures() -> dict[str, Column]:
    """The second keeps the axis filter and adds its own, so each month keeps its own value."""
    later = F.col("months_since_first_purchase") > 0
    return {"Avg Retention %": F.avg("retention_pct") / 100.0,
            "Retention % After Month 0": F.avg(F.when(later, F.col("retention_pct"))) / 100.0}


def cohort_measures() -> dict[str, Column]:
    return {"3-Month Repeat Rate %": F.avg("repeat_rate_3mo_pct") / 100.0}


def category_measures() -> dict[str, Column]:
    return {"Category Momentum": F.sum("momentum_change_brl"), "Category Units": F.sum("units"),
            "Category Avg Price": F.avg("avg_item_price")}


def forecast_measures() -> dict[str, Column]:
    return {"Actual Revenue": F.sum("actual"), "Forecast Revenue": F.sum("forecast"), "Forecast Lower 95": F.sum("lower_95"),
            "Forecast Upper 95": F.sum("upper_95")}


def measure_registry(defs: Definitions = Definitions(), one_row_per_order: bool = False) -> dict[str, dict[str, Column]]:
    """Table -> measure -> aggregate expression."""
    return {"fact_orders": order_measures(defs, one_row_per_order), "fact_order_items": item_measures(),
            "dim_customers_segmented": customer_measures(), "fact_cohort_retention": retention_measures(),
            "dim_cohort_summary": cohort_measures(), "dim_category_performance": category_measures(),
            "fact_revenue_forecast": forecast_measures()}


# Measures that are frame functions.
FRAME_MEASURES = ["AOV (Median)", "Revenue MoM %", "Segment Revenue %", "Next Month Forecast", "Next Month Lower 95",
                  "Next Month Upper 95"]


def median_order_value(orders: DataFrame, axis: Sequence[str] = ()) -> DataFrame:
    """AOV (Median), exact, per axis value."""
    return _median(orders, "revenue", list(axis), "AOV (Median)")


def revenue_mom(orders: DataFrame) -> DataFrame:
    """Revenue MoM %: trend revenue against the previous calendar month.

    The shift goes over a spine of all months, so a month after a gap has no predecessor; a month
    with truncated days is blank.
    """
    months = orders.groupBy("order_month").agg(
        F.coalesce(total(F.when(~F.col("is_truncated_period"), F.col("revenue"))), F.lit(0.0)).alias("trend"),
        F.max("is_truncated_period").alias("partial"))
    span = months.agg(F.min("order_month").alias("a"), F.max("order_month").alias("b"))
    spine = span.select(F.explode(F.sequence(F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01"))),
                                             F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("order_month"))
    before = F.lag("trend").over(everything().orderBy("order_month"))
    return spine.join(months, "order_month", "left").withColumn("before", before).where(F.col("trend").isNotNull()).select(
        "order_month", F.col("trend").alias("Revenue (Trend)"),
        F.when(~F.col("partial"), growth_pct("trend", "before") / 100.0).alias("Revenue MoM %"))


def segment_revenue_share(customers: DataFrame, axis: str, selected: Column | None = None) -> DataFrame:
    """Segment Revenue %: selected revenue per axis value over the revenue of *all* customers."""
    whole = scalar(customers.agg(F.sum("monetary_revenue").alias("r")), "r")["r"]
    kept = customers if selected is None else customers.where(selected)
    return kept.groupBy(axis).agg(total("monetary_revenue").alias("Segment Revenue"),
                                  F.sum("monetary_revenue").alias("r")).select(
        axis, "Segment Revenue", ratio("r", whole).alias("Segment Revenue %"))


def next_month(forecast: DataFrame) -> DataFrame:
    """Point and bounds of the first forecast month."""
    ahead = forecast.where(F.col("type") == "forecast")
    return ahead.agg(F.min_by("forecast", "period").alias("Next Month Forecast"),
                     F.min_by("lower_95", "period").alias("Next Month Lower 95"),
                     F.min_by("upper_95", "period").alias("Next Month Upper 95"))


def page_dataset(table: DataFrame, axis: Sequence[str], measures: Mapping[str, Column], slicers: Column | None = None,
                 order: Sequence[Column | str] = (), limit: int | None = None) -> DataFrame:
    """Measures by axis under the page's slicers, in display order."""
    kept = table if slicers is None else table.where(slicers)
    out = kept.groupBy(*axis).agg(*[m.alias(name) for name, m in measures.items()])
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit else out
