"""Revenue, product, payment, region and seller metrics over (filtered) star facts.

Inputs are ``fact_orders`` (one row per order) and ``fact_order_items`` frames. Order counts are
plain counts because the order fact has one row per order. Windows without a key run over frames
at month, state, category or payment grain only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.functions.bands import quadrant, table_instalment_band
from martlet.functions.numbers import big, cents, dbl, growth_pct, mean, pct, ratio, scalar, share_true, sum_where, total
from martlet.functions.windows import everything, running, share_of_all
from martlet.operators.ordered import exact_quantiles, histogram, running_before, share_curve
from martlet.operators.ranges import positions


def _r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _median(df: DataFrame, amount: str, groups: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median of money, per group."""
    return exact_quantiles(df.select(*groups, cents(amount).alias("_c")), "_c", {name: 0.5}, groups, unit=100)


# ------------------------------------------------------------------ overview

def kpis(orders: DataFrame) -> DataFrame:
    """Eleven headline numbers in one row.

    One pass to customer grain gives every additive figure and the repeat rate; the exact median
    is a scalar subquery over the revenue histogram.
    """
    people = orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.sum("freight").alias("freight"),
        F.sum("items_in_order").alias("items"), F.count_if("is_late").alias("late"),
        F.sum("review_score").alias("score"), F.count("review_score").alias("scored"),
        F.count_if(F.col("review_score") == 1).alias("one_star"))
    row = people.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 1).alias("repeaters"),
        *[F.sum(c).alias(c) for c in ("n", "revenue", "freight", "items", "late", "score", "scored", "one_star")])
    middle = scalar(_median(orders, "revenue"), "median")["median"]
    return row.select(
        dbl("revenue").alias("revenue"), F.col("n").alias("orders"), "customers", _r(ratio("revenue", "n")).alias("aov_mean"),
        _r(middle).alias("aov_median"), dbl("freight").alias("freight"), _r(ratio("items", "n")).alias("items_per_order"),
        _r(ratio("late", "n")).alias("late_rate"), _r(ratio("score", "scored")).alias("avg_review"),
        _r(ratio("one_star", "scored")).alias("one_star_rate"), _r(ratio("repeaters", "customers")).alias("repeat_rate"))


def monthly_revenue(orders: DataFrame, defs: Definitions) -> DataFrame:
    """Monthly revenue without the truncated tail; the cut month gets no growth figure."""
    months = orders.where(~F.col("is_truncated_period")).groupBy(F.col("order_month").alias("month")).agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"),
        F.countDistinct("customer_unique_id").alias("customers"))
    partial = F.col("month") == F.lit(defs.partial_month) if defs.partial_month else F.lit(False)
    change = growth_pct("revenue", F.lag("revenue").over(everything().orderBy("month")))
    return months.select("*", _r(ratio("revenue", "orders")).alias("aov"), partial.alias("partial_month"),
                         _r(F.when(~partial, change)).alias("mom_pct")).orderBy("month")


def revenue_by_state(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("customer_state").alias("state")).agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"), _r(mean("revenue")).alias("aov"),
        _r(share_true("is_late")).alias("late_rate"), _r(F.avg("review_score")).alias("avg_review"),
    ).withColumn("revenue_pct", _r(share_of_all("revenue"))).orderBy(F.desc("revenue"))


def revenue_by_category(items: DataFrame, limit: int = 15) -> DataFrame:
    """Shares are of all categories, also those beyond the limit."""
    return items.groupBy("category").agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"), F.countDistinct("order_id").alias("orders"),
    ).select("*", _r(ratio("revenue", "items")).alias("avg_price"), _r(share_of_all("revenue")).alias("revenue_pct"),
             ).orderBy(F.desc("revenue"), "category").limit(limit)


# ------------------------------------------------------------------ customers

def customers_summary(customers: DataFrame) -> DataFrame:
    middle = scalar(_median(customers, "monetary_revenue"), "median")["median"]
    return customers.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("is_repeat_customer").alias("repeat_customers"),
        _r(share_true("is_repeat_customer")).alias("repeat_rate"), total("monetary_revenue").alias("revenue"),
        _r(mean("monetary_revenue")).alias("avg_value"), _r(F.avg("recency_days")).alias("avg_recency_days"),
    ).withColumn("median_value", _r(middle))


def customer_segments(customers: DataFrame, by: str = "rfm_segment") -> DataFrame:
    return customers.groupBy(F.col(by).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), total("monetary_revenue").alias("revenue"),
        _r(F.avg("recency_days")).alias("avg_recency_days"), _r(F.avg("frequency_orders")).alias("avg_orders"),
        _r(mean("monetary_revenue")).alias("avg_value"),
    ).select("*", _r(share_of_all("customers")).alias("customer_pct"), _r(share_of_all("revenue")).alias("revenue_pct"),
             ).orderBy(F.desc("revenue"))


def orders_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of the selected customers only."""
    return orders.join(customers.select("customer_unique_id"), "customer_unique_id", "left_semi")


def top_customers(customers: DataFrame, limit: int = 20) -> DataFrame:
    wanted = ["customer_unique_id", "customer_state", "rfm_segment", "kmeans_segment", "risk_tier", "frequency_orders",
              "monetary_revenue", "avg_order_value", "recency_days", "distinct_categories"]
    return (customers.select(*[c for c in wanted if c in customers.columns])
            .orderBy(F.desc("monetary_revenue"), "customer_unique_id").limit(limit))


# ------------------------------------------------------------------ products

def _per_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("units"))


def product_pareto(items: DataFrame) -> DataFrame:
    """Concentration of revenue over products in one row."""
    products = _per_product(items)
    curve = share_curve(products.select(cents("revenue").alias("c")), "c", [1])
    once = scalar(products.agg(
        F.count_if(F.col("units") == 1).alias("n"),
        F.coalesce(F.sum(F.when(F.col("units") == 1, F.col("revenue"))), F.lit(0)).alias("r")), "n", "r")
    return curve.select(
        big("rows").alias("products"), big("rows_for_80pct").alias("products_for_80pct"),
        _r(pct("rows_for_80pct", "rows")).alias("pct_of_products_for_80pct"),
        _r("share_1").alias("top_1pct_revenue_share"), _r(pct(once["n"], "rows")).alias("sold_once_pct"),
        _r(pct(once["r"].cast("double") * 100, "amount")).alias("sold_once_revenue_pct"))


def pareto_curve(items: DataFrame) -> DataFrame:
    """The hundred points of the concentration curve."""
    at = list(range(1, 101))
    curve = share_curve(_per_product(items).select(cents("revenue").alias("c")), "c", at)
    return curve.select(F.inline(F.array(*[
        F.struct(F.lit(q).cast("bigint").alias("pct_products"), _r(f"share_{q}", 3).alias("pct_revenue")) for q in at])))


def product_summary(items: DataFrame) -> DataFrame:
    facts = scalar(items.agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"), F.countDistinct("category").alias("cats")),
        "revenue", "items", "cats")
    return product_pareto(items).select(
        "*", dbl(facts["revenue"]).alias("revenue"), big(facts["items"]).alias("items_sold"),
        _r(ratio(facts["revenue"], facts["items"])).alias("avg_item_price"), big(facts["cats"]).alias("categories"))


def category_table(items: DataFrame, defs: Definitions, quadrants: DataFrame | None = None) -> DataFrame:
    """Category revenue, volume, price and momentum; momentum keeps small categories."""
    recent, prior = defs.recent_span, defs.prior_span
    now, then = f"revenue_{recent.tag}", f"revenue_{prior.tag}"
    cats = items.groupBy("category").agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("units"), F.countDistinct("order_id").alias("orders"),
        F.countDistinct("product_id").alias("products"), total("freight").alias("freight"),
        sum_where(F.col("order_month").isin(*prior.months), "revenue").alias(then),
        sum_where(F.col("order_month").isin(*recent.months), "revenue").alias(now))
    change = F.round(F.col(now) - F.col(then), 2)
    out = cats.select(
        "category", "revenue", "units", "orders", "products", _r(ratio("revenue", "units")).alias("avg_item_price"),
        _r(share_of_all("revenue")).alias("pct_of_revenue"), _r(pct("freight", "revenue")).alias("freight_pct_of_revenue"),
        then, now, change.alias("momentum_change_brl"),
        _r(pct(change, F.when(F.col(then) > 0, F.col(then)))).alias("momentum_change_pct"))
    if quadrants is not None:
        out = out.join(quadrants.select("category", "quadrant"), "category", "left")
    return out.orderBy(F.desc("revenue"), "category")


def momentum_extremes(table: DataFrame, defs: Definitions, each: int = 8) -> DataFrame:
    """Strongest risers and fallers, each category once."""
    active = table.where((F.col(f"revenue_{defs.prior_span.tag}") > 0) | (F.col(f"revenue_{defs.recent_span.tag}") > 0))
    picked = active.select("category", "momentum_change_brl", "momentum_change_pct")
    up = picked.orderBy(F.desc("momentum_change_brl"), "category").limit(each)
    down = picked.orderBy("momentum_change_brl", "category").limit(each)
    return up.unionByName(down).dropDuplicates(["category"])


def top_products(items: DataFrame, limit: int = 20) -> DataFrame:
    products = items.groupBy("product_id", "category").agg(
        F.count(F.lit(1)).alias("units"), total("revenue").alias("revenue"), F.countDistinct("seller_id").alias("sellers"))
    whole = scalar(items.agg(F.sum("revenue").alias("revenue")), "revenue")["revenue"]
    order = everything().orderBy(F.desc("revenue"), "product_id", "category")
    best = products.orderBy(F.desc("revenue"), "product_id", "category").limit(limit)
    return best.select(
        "*", _r(ratio("revenue", "units")).alias("avg_item_price"),
        big(F.row_number().over(order)).alias("revenue_rank"),
        _r(pct(running("revenue", order), whole)).alias("cumulative_pct_of_revenue")).orderBy("revenue_rank")


# Quadrant names, (premium, high volume) first, and the label below the unit floor.
TABLE_QUADRANTS = {(True, True): "Premium + high volume", (True, False): "Premium + low volume",
                   (False, True): "Budget + high volume", (False, False): "Budget + low volume"}


def category_performance(items: DataFrame) -> DataFrame:
    """Category table with exact median price and running share."""
    cats = items.groupBy("category").agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("units_sold"), F.countDistinct("order_id").alias("orders"),
        F.countDistinct("product_id").alias("products"), ratio(F.sum("revenue"), F.count(F.lit(1))).alias("avg_selling_price"),
        total("freight").alias("freight"))
    order = everything().orderBy(F.desc("revenue"), "category")
    whole = F.sum("revenue").over(everything())
    return cats.withColumns({
        "revenue_pct": share_of_all("revenue"), "cum_pct": F.try_divide(100.0 * running("revenue", order), whole),
    }).join(_median(items, "revenue", ["category"], "median_price"), "category")


def product_performance(items: DataFrame) -> DataFrame:
    """One row per product: volume, revenue, price range, sellers."""
    return items.groupBy("product_id").agg(
        F.min("category").alias("category"), F.count(F.lit(1)).alias("units_sold"),
        F.countDistinct("order_id").alias("orders"), F.sum("revenue").cast("decimal(18,2)").alias("revenue"),
        ratio(F.sum("revenue"), F.count(F.lit(1))).alias("avg_selling_price"), F.min("revenue").cast("double").alias("min_price"),
        F.max("revenue").cast("double").alias("max_price"), total("freight").alias("freight"),
        F.countDistinct("seller_id").alias("sellers"))


def ranked_by_revenue(df: DataFrame, key: str) -> DataFrame:
    """Add ``revenue_rank`` and ``cumulative_pct_of_revenue`` to a large table with DECIMAL revenue.

    Ranks and running amounts come from ranges of the order, so one price or one key prefix holds up no task.
    """
    placed = positions(df.withColumn("_c", cents("revenue")), "_c", key, "revenue_rank", True, {"amount": F.col("_c")})
    return placed.withColumn("cumulative_pct_of_revenue", F.round(pct("amount", "amount_total"), 3)).drop(
        "_c", "amount", "amount_total", "revenue_rank_before", "revenue_rank_total")


def price_volume_quadrants(items: DataFrame, min_units: int) -> DataFrame:
    """Quadrant of every category with enough units, against the medians of those categories."""
    cats = items.groupBy("category").agg(
        total("revenue").alias("revenue"), F.count(F.lit(1)).alias("units_sold"),
        ratio(F.sum("revenue"), F.count(F.lit(1))).alias("avg_selling_price")).where(F.col("units_sold") >= min_units)
    placed = cats.withColumns({"mid_price": F.median("avg_selling_price").over(everything()),
                               "mid_units": F.median("units_sold").over(everything())})
    name = quadrant(F.col("avg_selling_price") >= F.col("mid_price"), F.col("units_sold") >= F.col("mid_units"), TABLE_QUADRANTS)
    return placed.withColumn("quadrant", name).drop("mid_price", "mid_units")


def quadrant_profile(quadrants: DataFrame) -> DataFrame:
    return quadrants.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("categories"), _r(F.sum("revenue"), 2).alias("revenue"), F.sum("units_sold").alias("units"),
        _r(F.avg("avg_selling_price")).alias("avg_price")).withColumn("revenue_pct", _r(share_of_all("revenue")))


def momentum(items: DataFrame, defs: Definitions) -> DataFrame:
    """Change per category, only those above the prior-period floor."""
    cats = items.groupBy("category").agg(
        sum_where(F.col("order_month").isin(*defs.prior_span.months), "revenue").alias("revenue_prior"),
        sum_where(F.col("order_month").isin(*defs.recent_span.months), "revenue").alias("revenue_recent"))
    return cats.where(F.col("revenue_prior") > defs.momentum_floor).select(
        "*", F.round(F.col("revenue_recent") - F.col("revenue_prior"), 2).alias("change"),
        _r(growth_pct("revenue_recent", "revenue_prior")).alias("change_pct"))


def momentum_summary(items: DataFrame, defs: Definitions) -> DataFrame:
    up, down = F.col("change") > 0, F.col("change") < 0
    return momentum(items, defs).agg(
        F.count_if(up).alias("growing"), F.count_if(down).alias("declining"),
        F.round(sum_where(up, "change"), 2).alias("gained"), F.round(sum_where(down, "change"), 2).alias("lost"),
        F.round(F.sum("change"), 2).alias("net_change"))


def freight_burden(items: DataFrame, min_units: int) -> DataFrame:
    """Freight share per category with the price-freight correlation on every row."""
    cats = items.groupBy("category").agg(
        total("revenue").alias("revenue"), total("freight").alias("freight"), F.count(F.lit(1)).alias("units_sold"),
        ratio(F.sum("revenue"), F.count(F.lit(1))).alias("price")).where(F.col("units_sold") >= min_units)
    shared = cats.withColumn("burden", pct("freight", "revenue"))
    return shared.select(
        "category", "units_sold", _r("price").alias("avg_selling_price"), "revenue", "freight",
        _r("burden").alias("freight_pct_of_revenue"),
        _r(F.corr("price", "burden").over(everything()), 6).alias("price_freight_correlation"))


def premium_routes(items: DataFrame, top: int = 10, quantile: float = 0.95) -> DataFrame:
    """Do the best products win by price or by volume? Cut at the 95th percentile of product price."""
    products = items.groupBy("product_id").agg(
        F.min("category").alias("category"), F.count(F.lit(1)).alias("units_sold"), F.sum("revenue").alias("revenue"))
    # average prices as integers of 1e-6, so that the percentile is an exact order statistic
    priced = products.withColumn("price_units", F.round(ratio("revenue", "units_sold") * 1_000_000).cast("bigint"))
    cut = scalar(exact_quantiles(priced.select("price_units"), "price_units", {"cut": quantile}), "cut")["cut"]
    # Route labels.
    route = F.when(F.col("price_units") > cut, "premium (few units, high price)").otherwise("volume (many units, low price)")
    return priced.orderBy(F.desc("revenue"), "product_id").limit(top).select(
        "product_id", "category", "units_sold", F.round(ratio("revenue", "units_sold"), 4).alias("avg_selling_price"),
        dbl("revenue").alias("revenue"), route.alias("route"))


# ------------------------------------------------------------------ marketing

def payment_mix(orders: DataFrame) -> DataFrame:
    kinds = orders.na.drop(subset=["payment_type"]).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("orders"), total("revenue").alias("revenue"), _r(mean("revenue")).alias("aov"),
        _r(F.avg("review_score")).alias("avg_review"), _r(F.avg("max_installments")).alias("avg_installments"),
        _r(F.avg("items_in_order")).alias("avg_items"))
    middle = _median(orders.na.drop(subset=["payment_type"]), "revenue", ["payment_type"], "median_value")
    return kinds.select("*", _r(share_of_all("orders")).alias("order_pct"), _r(share_of_all("revenue")).alias("revenue_pct"),
                        ).join(middle, "payment_type").withColumn("median_value", _r("median_value")).orderBy(F.desc("revenue"))


def instalment_curve(orders: DataFrame, defs: Definitions) -> DataFrame:
    """Card order value by instalment count, counts with enough orders only."""
    return orders.where(F.col("payment_type") == defs.instalment_payment).groupBy(
        F.col("max_installments").alias("installments")).agg(
        F.count(F.lit(1)).alias("orders"), _r(mean("revenue")).alias("aov"), _r(F.avg("review_score")).alias("avg_review"),
    ).where(F.col("orders") >= defs.min_group).orderBy("installments")


def instalment_bands(orders: DataFrame, defs: Definitions) -> DataFrame:
    """Right-closed instalment bins of card orders."""
    card = orders.where(F.col("payment_type") == defs.instalment_payment).withColumn(
        "installment_band", table_instalment_band("max_installments")).na.drop(subset=["installment_band"])
    bands = card.groupBy("installment_band").agg(
        F.count(F.lit(1)).alias("orders_n"), _r(mean("revenue")).alias("aov"), total("revenue").alias("revenue"),
        _r(F.avg("review_score")).alias("avg_review"), _r(F.avg("items_in_order")).alias("avg_items"))
    return bands.withColumn("pct_of_orders", _r(share_of_all("orders_n"))).join(
        _median(card, "revenue", ["installment_band"], "median_value"), "installment_band").withColumn(
        "median_value", _r("median_value"))


def region_scorecard(orders: DataFrame, min_orders: int = 0) -> DataFrame:
    """State scorecard; shares are taken before small states are dropped."""
    states = orders.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("customer_unique_id").alias("customers"),
        total("revenue").alias("revenue"), total("freight").alias("freight"), _r(mean("revenue")).alias("aov"),
        _r(F.avg("delivery_days")).alias("avg_delivery_days"), _r(100.0 * share_true("is_late")).alias("late_rate_pct"),
        _r(F.avg("review_score")).alias("avg_review_score"))
    return states.select(
        "customer_state", "orders", "customers", "revenue", "aov", "avg_delivery_days", "avg_review_score", "late_rate_pct",
        _r(pct("freight", "revenue")).alias("freight_pct_of_revenue"), _r(share_of_all("revenue")).alias("pct_of_revenue"),
    ).where(F.col("orders") >= min_orders).orderBy(F.desc("revenue"))


def region_correlations(scorecard: DataFrame) -> DataFrame:
    """How delivery time and freight go with order value and satisfaction across states."""
    return scorecard.agg(
        F.count(F.lit(1)).alias("states"), _r(F.corr("avg_delivery_days", "aov"), 6).alias("days_vs_aov"),
        _r(F.corr("avg_delivery_days", "avg_review_score"), 6).alias("days_vs_review"),
        _r(F.corr("freight_pct_of_revenue", "aov"), 6).alias("freight_vs_aov"))


def seller_service_table(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Revenue and service quality of every seller; each order counts once per seller."""
    pairs = items.groupBy("seller_id", "seller_state", "order_id").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("items"))
    served = pairs.join(orders.select("order_id", "delivery_days", "is_late", "review_score"), "order_id")
    sellers = served.groupBy("seller_id", "seller_state").agg(
        F.sum("revenue").cast("decimal(18,2)").alias("revenue"), F.sum("items").alias("items_sold"),
        F.count(F.lit(1)).alias("orders_n"), _r(F.avg("delivery_days")).alias("avg_delivery_days"),
        _r(100.0 * share_true("is_late")).alias("late_rate_pct"), _r(F.avg("review_score")).alias("avg_review_score"))
    breadth = items.groupBy(F.col("seller_id").alias("_id"), F.col("seller_state").alias("_state")).agg(F.countDistinct("product_id").alias("products"))
    whole = scalar(items.agg(F.sum("revenue").alias("revenue")), "revenue")["revenue"]
    same = F.col("seller_id").eqNullSafe(F.col("_id")) & F.col("seller_state").eqNullSafe(F.col("_state"))
    return sellers.join(breadth, same).drop("_id", "_state").withColumns({
        "avg_item_price": _r(ratio("revenue", "items_sold")), "pct_of_revenue": _r(pct("revenue", whole))})


def seller_scorecard(items: DataFrame, orders: DataFrame, limit: int = 20, min_orders: int = 0) -> DataFrame:
    """Largest sellers with at least ``min_orders`` orders; shares are of all sellers."""
    return (seller_service_table(items, orders).where(F.col("orders_n") >= min_orders)
            .withColumn("revenue", dbl("revenue")).drop("avg_item_price")
            .orderBy(F.desc("revenue"), "seller_id").limit(limit))


def late_sellers(items: DataFrame, orders: DataFrame, min_orders: int = 100, top: int = 8) -> DataFrame:
    """Worst late rates among high-volume sellers, and how lateness goes with reviews."""
    big_ones = seller_service_table(items, orders).where(F.col("orders_n") >= min_orders)
    link = scalar(big_ones.agg(_r(F.corr("late_rate_pct", "avg_review_score"), 6).alias("c")), "c")["c"]
    return big_ones.orderBy(F.desc("late_rate_pct"), "seller_id").limit(top).select(
        "seller_id", "seller_state", dbl("revenue").alias("revenue"), "orders_n", "late_rate_pct", "avg_delivery_days",
        "avg_review_score", link.alias("late_review_correlation"))


def regional_mix(items: DataFrame, state: str) -> DataFrame:
    """Category mix of one state against the nation, in percentage points."""
    cats = items.groupBy("category").agg(
        total("revenue").alias("nation"), F.sum(F.when(F.col("customer_state") == state, F.col("revenue"))).cast("double").alias("here"))
    return cats.select("category", share_of_all("here").alias("h"), share_of_all("nation").alias("n")).na.drop(
        subset=["h"]).select("category", _r("h").alias("state_pct"), _r("n").alias("national_pct"),
                             _r(F.col("h") - F.col("n")).alias("pp_vs_national"))


def top_category_per_state(items: DataFrame, min_orders: int, orders: DataFrame) -> DataFrame:
    """Best category of each large state (``max_by`` instead of a sort per state)."""
    cells = items.groupBy("customer_state", "category").agg(F.sum("revenue").alias("revenue"))
    best = cells.groupBy("customer_state").agg(
        F.max_by("category", F.struct(F.col("revenue"), F.col("category"))).alias("category"),
        F.max("revenue").alias("top"), F.sum("revenue").alias("whole"))
    large = orders.groupBy("customer_state").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_orders)
    return best.join(large, "customer_state", "left_semi").select(
        "customer_state", "category", dbl("top").alias("revenue"), _r(pct("top", "whole")).alias("pct_of_state"))


# ------------------------------------------------------------------ exploration

def basket_bands(orders: DataFrame) -> DataFrame:
    """Orders by number of items."""
    sizes = orders.groupBy("items_in_order").agg(
        F.count(F.lit(1)).alias("orders"), _r(mean("revenue")).alias("mean_value"),
        _r(F.avg("avg_item_price")).alias("mean_item_price"))
    return sizes.withColumn("pct", _r(share_of_all("orders"))).join(
        _median(orders, "revenue", ["items_in_order"], "median_value"), "items_in_order").withColumn(
        "median_value", _r("median_value")).orderBy("items_in_order")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Histogram of an integer column with the average rank of each value (ties share it)."""
    h = running_before(histogram(df, value), value, ["n"])
    return h.select(value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two integer columns.

    Rows are first reduced to one per pair of values; ranks come from the value histograms, so
    nothing is sorted globally.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = cells.join(average_ranks(rows, x, "rx"), x).join(average_ranks(rows, y, "ry"), y)
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.agg(F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"),
                   F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    num = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    den = F.sqrt(F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * F.sqrt(F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    return s.select(_r(F.try_divide(num, den), 6).alias("spearman"))


def value_drivers(orders: DataFrame) -> DataFrame:
    """What moves order value: quantity or unit price. Pearson, explained variance and Spearman."""
    ints = orders.select("items_in_order", cents("revenue").alias("rc"), cents("avg_item_price").alias("pc"))
    by_items = scalar(spearman(ints, "items_in_order", "rc"), "spearman")["spearman"]
    by_price = scalar(spearman(ints, "pc", "rc"), "spearman")["spearman"]
    rev, n, price = dbl("revenue"), dbl("items_in_order"), F.col("avg_item_price")
    return orders.agg(
        _r(F.corr(n, rev), 6).alias("items_pearson"), _r(F.corr(price, rev), 6).alias("price_pearson"),
        _r(F.corr(n, price), 6).alias("items_vs_price"), _r(100.0 * F.regr_r2(rev, n)).alias("items_r2_pct"),
        _r(100.0 * F.regr_r2(rev, price)).alias("price_r2_pct"),
    ).select("*", by_items.alias("items_spearman"), by_price.alias("price_spearman"))


def weekday_table(orders: DataFrame) -> DataFrame:
    """Orders, revenue and order value per weekday, Monday first."""
    return orders.groupBy(cal.weekday_number("order_timestamp").cast("bigint").alias("weekday_number"),
                          cal.day_name("order_timestamp").alias("weekday")).agg(
        F.count(F.lit(1)).alias("orders_n"), total("revenue").alias("revenue"), _r(mean("revenue")).alias("aov"),
    ).orderBy("weekday_number")


def weekday_hour_counts(df: DataFrame, ts: str) -> DataFrame:
    """Counts for all 168 weekday and hour cells; empty cells are zero."""
    spark = df.sparkSession
    cells = df.groupBy(cal.weekday_number(ts).alias("weekday_number"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(168).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("weekday_number"),
                                    (F.col("id") % 24).cast("int").alias("hour"))
    return spine.join(cells, ["weekday_number", "hour"], "left").select(
        big("weekday_number").alias("weekday_number"), big("hour").alias("hour"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def weekday_hour_pivot(df: DataFrame, ts: str) -> DataFrame:
    """The same as a matrix, one column per hour."""
    return weekday_hour_counts(df, ts).groupBy("weekday_number").pivot("hour", list(range(24))).agg(F.sum("n")).select(
        "weekday_number", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)]).orderBy("weekday_number")


def daily_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("orders_n"), total("revenue").alias("revenue"))


def busiest_days(orders: DataFrame, top: int = 6) -> DataFrame:
    """Days with most orders against the median day. The day frame is calendar-sized."""
    days = daily_totals(orders).withColumns({"mid_n": F.median("orders_n").over(everything()),
                                             "mid_r": F.median("revenue").over(everything())})
    return days.orderBy(F.desc("orders_n"), "order_date").limit(top).select(
        "order_date", "orders_n", "revenue", _r(ratio("orders_n", "mid_n")).alias("orders_vs_median"),
        _r(ratio("revenue", "mid_r")).alias("revenue_vs_median"))


def around_event(orders: DataFrame, event: date, days: int = 7) -> DataFrame:
    """Revenue of the days before and after an event day; the day itself is left out."""
    d = F.col("order_date")
    before = (d >= F.lit(event - timedelta(days=days))) & (d < F.lit(event))
    after = (d > F.lit(event)) & (d <= F.lit(event + timedelta(days=days)))
    window = orders.where(d.between(F.lit(event - timedelta(days=days)), F.lit(event + timedelta(days=days))))
    return window.agg(sum_where(before, "revenue").alias("before"), sum_where(d == F.lit(event), "revenue").alias("event_day"),
                      sum_where(after, "revenue").alias("after")).withColumn("change_pct", _r(growth_pct("after", "before")))


def like_for_like_months(orders: DataFrame, months: Sequence[str], last_day: int = 21) -> DataFrame:
    """Months compared on their first days only, beside the raw month totals."""
    early = F.dayofmonth("order_date") <= last_day
    rows = orders.where(F.col("order_month").isin(*months)).groupBy(F.col("order_month").alias("month")).agg(
        F.count_if(early).alias("orders"), sum_where(early, "revenue").alias(f"revenue_days_1_{last_day}"),
        total("revenue").alias("raw_month_total"))
    amount = f"revenue_days_1_{last_day}"
    before = F.lag(amount).over(everything().orderBy("month"))
    return rows.select(
        "*", _r(F.col(amount) / F.lit(float(last_day))).alias("revenue_per_day"), _r(ratio(amount, "orders")).alias("aov"),
        _r(growth_pct(amount, before)).alias("mom_pct")).orderBy("month")


def reviews_by_lateness(orders: DataFrame) -> DataFrame:
    scored = orders.na.drop(subset=["review_score"])
    label = F.when(F.col("is_late"), "late").otherwise("on time / early")
    return scored.groupBy(label.alias("delivery")).agg(
        F.count(F.lit(1)).alias("orders"), _r(F.avg("review_score")).alias("mean_score"),
        _r(100.0 * share_true(F.col("review_score") == 1)).alias("one_star_rate"),
        _r(100.0 * share_true(F.col("review_score") == 5)).alias("five_star_rate"))


def delivery_by_score(orders: DataFrame) -> DataFrame:
    """Delivery time and lateness per score. Days are rounded to 0.01, so the median histogram is small."""
    scored = orders.na.drop(subset=["review_score"])
    units = scored.select("review_score", F.round(F.col("delivery_days") * 100).cast("bigint").alias("u"))
    middle = exact_quantiles(units, "u", {"median_days": 0.5}, ["review_score"], unit=100)
    return scored.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("orders"), _r(F.avg("delivery_days")).alias("mean_days"),
        _r(100.0 * share_true("is_late")).alias("late_rate")).join(middle, "review_score", "left").withColumn(
        "median_days", _r("median_days")).orderBy("review_score")


def estimate_padding(orders: DataFrame) -> DataFrame:
    """Mean days between delivery and promise, by outcome; orders without delivery are left out."""
    label = F.when(F.col("is_late"), "late").otherwise("on time / early")
    return orders.na.drop(subset=["delivery_vs_estimate_days"]).groupBy(label.alias("delivery")).agg(
        F.count(F.lit(1)).alias("orders"), _r(F.avg("delivery_vs_estimate_days")).alias("mean_days_vs_estimate"),
        _r(F.avg("estimated_days")).alias("mean_promised_days"))


def rank_states(states: DataFrame, column: str) -> DataFrame:
    """Which state is highest and lowest in a column (ties by name)."""
    key = F.struct(F.col(column), F.col("state"))
    return states.agg(F.max_by("state", key).alias("highest"), F.max(column).alias("highest_value"),
                      F.min_by("state", key).alias("lowest"), F.min(column).alias("lowest_value"))
