"""Named payment, region, seller-service and delivery queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.bands import query_instalment_band
from martlet.functions.numbers import big, dbl, ratio, rounded_pct, scalar, share_true, total
from martlet.functions.windows import everything
from martlet.operators.facts import payment_rollup
from martlet.operators.views import analysis_items, analysis_orders, order_revenue
from martlet.sources.market import Market


def _scores(m: Market) -> DataFrame:
    return m.reviews.select("order_id", "review_score")


def payment_method_performance(m: Market) -> DataFrame:
    """Orders by the payment type that carried most of their value."""
    paid = payment_rollup(m.payments).select("order_id", "payment_type", "dominant_installments")
    orders = order_revenue(m).join(paid, "order_id").join(_scores(m), "order_id", "left")
    kinds = orders.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("orders"), total("revenue").alias("revenue"),
        ratio(total("revenue"), F.count(F.lit(1))).alias("exact_aov"),
        F.round(F.avg("dominant_installments"), 2).alias("avg_installments"),
        F.round(F.avg("review_score"), 3).alias("avg_review_score"))
    return kinds.select(
        "payment_type", "orders", rounded_pct("orders", F.sum("orders").over(everything())).alias("pct_of_orders"),
        "revenue", rounded_pct("revenue", F.sum("revenue").over(everything())).alias("pct_of_revenue"),
        F.round("exact_aov", 2).alias("aov"), "avg_installments", "avg_review_score",
        big(F.rank().over(everything().orderBy(F.desc("exact_aov")))).alias("aov_rank")).orderBy(F.desc("revenue"))


def installment_behaviour(m: Market) -> DataFrame:
    """Card orders by the largest instalment count of their card payments."""
    card = (m.payments.where(F.col("is_valid_payment") & (F.col("payment_type") == m.defs.instalment_payment))
            .groupBy("order_id").agg(F.max("payment_installments").alias("installments")))
    orders = order_revenue(m).join(card, "order_id").join(_scores(m), "order_id", "left")
    bands = orders.groupBy(query_instalment_band("installments").alias("installment_band")).agg(
        F.count(F.lit(1)).alias("orders"), total("revenue").alias("revenue"),
        F.round(F.avg("review_score"), 3).alias("avg_review_score"))
    return bands.select(
        "installment_band", "orders", rounded_pct("orders", F.sum("orders").over(everything())).alias("pct_of_orders"),
        F.round(ratio("revenue", "orders"), 2).alias("aov"), "revenue", "avg_review_score",
    ).orderBy("installment_band")


def regional_performance_scorecard(m: Market) -> DataFrame:
    """State scorecard with three rankings; states without any line are left out."""
    lines = order_revenue(m).select("order_id", "revenue", "freight")
    orders = analysis_orders(m).join(lines, "order_id", "left").join(_scores(m), "order_id", "left")
    states = orders.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("orders"), total("revenue").alias("revenue"), total("freight").alias("freight"),
        F.avg("delivery_days").alias("days"), share_true("is_late").alias("late"),
        F.avg("review_score").alias("score")).where(F.col("revenue").isNotNull())
    kept = states.where(F.col("orders") >= m.defs.min_orders_per_state)
    aov = ratio("revenue", "orders")
    return kept.select(
        "customer_state", "orders", "revenue", F.round(aov, 2).alias("aov"),
        rounded_pct("freight", "revenue").alias("freight_pct_of_revenue"),
        F.round("days", 1).alias("avg_delivery_days"), F.round(100.0 * F.col("late"), 2).alias("late_rate_pct"),
        F.round("score", 3).alias("avg_review_score"),
        big(F.rank().over(everything().orderBy(F.desc("revenue")))).alias("revenue_rank"),
        big(F.rank().over(everything().orderBy(aov.desc()))).alias("aov_rank"),
        big(F.rank().over(everything().orderBy("days"))).alias("speed_rank")).orderBy(F.desc("revenue"))


def seller_service(m: Market) -> DataFrame:
    """Seller revenue and the service its orders received; each order counts once per seller."""
    lines = analysis_items(m)
    pairs = lines.groupBy("seller_id", "seller_state", "order_id").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"),
        F.max("delivery_days").alias("delivery_days"), F.max("is_late").alias("is_late"))
    service = pairs.join(_scores(m), "order_id", "left").groupBy("seller_id", "seller_state").agg(
        F.sum("items").alias("items"), F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"),
        F.avg("delivery_days").alias("days"), share_true("is_late").alias("late"), F.avg("review_score").alias("score"))
    breadth = lines.groupBy("seller_id").agg(F.countDistinct("product_id").alias("products"))
    return service.join(breadth, "seller_id")


def seller_performance_proxy(m: Market, top: int = 20) -> DataFrame:
    sellers = seller_service(m)
    whole = scalar(analysis_items(m).agg(total("revenue").alias("revenue")), "revenue")["revenue"]
    best = sellers.orderBy(F.desc("revenue"), "seller_id").limit(top)
    return best.select(
        big(F.row_number().over(everything().orderBy(F.desc("revenue"), "seller_id"))).alias("rank"),
        "seller_id", "seller_state", "orders", "products", dbl("revenue").alias("revenue"),
        F.round(ratio("revenue", "items"), 2).alias("avg_item_price"),
        rounded_pct("revenue", whole, 3).alias("pct_of_revenue"), F.round("days", 1).alias("avg_delivery_days"),
        F.round(100.0 * F.col("late"), 2).alias("late_rate_pct"), F.round("score", 3).alias("avg_review_score"),
    ).orderBy("rank")


def category_mix_by_region(m: Market) -> DataFrame:
    """The best category of every state with enough revenue."""
    cells = analysis_items(m).groupBy("customer_state", "category").agg(
        F.sum("revenue").alias("revenue"), F.countDistinct("order_id").alias("orders"))
    in_state = Window.partitionBy("customer_state")
    ranked = cells.withColumns({
        "place": F.row_number().over(in_state.orderBy(F.desc("revenue"), "category")),
        "whole": F.sum("revenue").over(in_state)})
    kept = ranked.where((F.col("place") == 1) & (F.col("whole") > m.defs.min_state_revenue))
    return kept.select(
        "customer_state", F.col("category").alias("top_category"), dbl("revenue").alias("category_revenue"),
        "orders", rounded_pct("revenue", "whole").alias("pct_of_state_revenue"),
        dbl("whole").alias("state_total_revenue")).orderBy(F.desc("state_total_revenue"))


def delivery_experience_vs_repeat(m: Market) -> DataFrame:
    """Did a late first order keep people from coming back?

    The first order is picked by ``min_by`` inside one aggregation per customer: no sort, and the
    orders of a very active customer combine before the shuffle.
    """
    orders = analysis_orders(m).join(_scores(m), "order_id", "left")
    first = F.min_by(F.struct("is_late", "delivery_days", "review_score"), F.struct("order_date", "order_id"))
    people = orders.groupBy("customer_unique_id").agg(first.alias("first"), F.count(F.lit(1)).alias("orders"))
    came_back = F.count_if(F.col("orders") > 1)
    label = F.when(F.col("first.is_late"), "first order was LATE").otherwise("first order on time")
    return people.groupBy(label.alias("first_experience")).agg(
        F.count(F.lit(1)).alias("customers"), came_back.alias("came_back"),
        rounded_pct(came_back, F.count(F.lit(1)), 3).alias("repeat_rate_pct"),
        F.round(F.avg("first.review_score"), 3).alias("avg_review_score"),
        F.round(F.avg("first.delivery_days"), 1).alias("avg_delivery_days"))


MARKETING_QUERIES = {f.__name__: f for f in (
    payment_method_performance, installment_behaviour, regional_performance_scorecard,
    seller_performance_proxy, category_mix_by_region, delivery_experience_vs_repeat)}
