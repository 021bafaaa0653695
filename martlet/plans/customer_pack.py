"""Named customer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions import calendar as cal
from martlet.functions.bands import frequency_score
from martlet.functions.numbers import big, cents, dbl, pct, ratio, rounded_pct, scalar, total
from martlet.functions.windows import everything
from martlet.operators.ordered import histogram, ntile_at, row_positions, running_before, tile_slices
from martlet.operators.ranges import positions_of
from martlet.operators.views import analysis_orders, customer_value, order_revenue
from martlet.sources.market import Market


def top_customers_ranked(m: Market, top: int = 20) -> DataFrame:
    """Best customers by spend, with their standing by order count among *all* customers.

    The order-count ranks come from a histogram of order counts, so customers are never sorted in
    one task; the spend rank is taken inside the top rows.
    """
    people = customer_value(m, "customer_state")
    by_orders = running_before(
        people.groupBy("orders").agg(F.count(F.lit(1)).alias("people")).withColumn("step", F.lit(1).cast("bigint")),
        "orders", ["people", "step"], descending=True)
    whole = scalar(people.agg(total("spend").alias("spend")), "spend")["spend"]
    best = people.orderBy(F.desc("spend"), "customer_unique_id", "customer_state").limit(top)
    standing = by_orders.select("orders", (F.col("people_before") + 1).alias("rank_by_orders"),
                                (F.col("step_before") + 1).alias("dense_rank_by_orders"))
    place = F.row_number().over(everything().orderBy(F.desc("spend"), "customer_unique_id", "customer_state"))
    return best.join(standing, "orders").select(
        big(place).alias("row_number_rank"), big("rank_by_orders").alias("rank_by_orders"),
        big("dense_rank_by_orders").alias("dense_rank_by_orders"), "customer_unique_id", "customer_state",
        "orders", dbl("spend").alias("lifetime_spend"), F.round(ratio("spend", "orders"), 2).alias("aov"),
        "first_purchase", "last_purchase", F.round(pct("spend", whole), 4).alias("pct_of_total_revenue"),
    ).orderBy("row_number_rank")


def repeat_vs_one_time(m: Market) -> DataFrame:
    kind = F.when(F.col("orders") == 1, "one-time buyer").otherwise("repeat buyer")
    groups = customer_value(m).groupBy(kind.alias("customer_type")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("total_orders"),
        total("spend").alias("total_revenue"))
    return groups.select(
        "customer_type", "customers",
        rounded_pct("customers", F.sum("customers").over(everything())).alias("pct_of_customers"),
        "total_orders", "total_revenue",
        rounded_pct("total_revenue", F.sum("total_revenue").over(everything())).alias("pct_of_revenue"),
        F.round(ratio("total_revenue", "customers"), 2).alias("avg_lifetime_spend"),
        F.round(ratio("total_revenue", "total_orders"), 2).alias("aov")).orderBy(F.desc("total_revenue"))


def order_frequency_distribution(m: Market) -> DataFrame:
    """Customers per order count. Order counts are few, so the running total may be global."""
    counts = (analysis_orders(m).groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("orders_placed"))
              .groupBy("orders_placed").agg(F.count(F.lit(1)).alias("customers")))
    spread = running_before(counts, "orders_placed", ["customers"])
    so_far = F.col("customers_before") + F.col("customers")
    return spread.select(
        "orders_placed", "customers", rounded_pct("customers", "customers_total", 3).alias("pct_of_customers"),
        big(so_far).alias("cumulative_customers"),
        rounded_pct(so_far, "customers_total", 3).alias("cumulative_pct")).orderBy("orders_placed")


def first_and_last_purchase_per_customer(m: Market, top: int = 25, min_orders: int = 3) -> DataFrame:
    """Purchase sequences of the most frequent customers.

    Counts and extreme dates are plain aggregates. Only the ``top`` most frequent customers can
    reach the report, and of each only the first ``top`` purchases, so the window sees at most that
    many rows per customer (the row-number limit is applied before the shuffle).
    """
    orders = analysis_orders(m).select("customer_unique_id", "order_id", "order_date")
    people = orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("total_orders"), F.min("order_date").alias("first_purchase"),
        F.max("order_date").alias("last_purchase")).where(F.col("total_orders") >= min_orders)
    busiest = people.orderBy(F.desc("total_orders"), "customer_unique_id").limit(top)
    own = Window.partitionBy("customer_unique_id").orderBy("order_date", "order_id")
    early = (orders.join(F.broadcast(busiest), "customer_unique_id")
             .withColumn("purchase_seq", F.row_number().over(own)).where(F.col("purchase_seq") <= top))
    before = F.lag("order_date").over(Window.partitionBy("customer_unique_id").orderBy("purchase_seq"))
    return early.withColumn("prev_order_date", before).select(
        "customer_unique_id", big("purchase_seq").alias("purchase_seq"), "order_date", "prev_order_date",
        big(F.date_diff("order_date", "prev_order_date")).alias("days_since_prev_order"), "total_orders",
        "first_purchase", "last_purchase", cal.dates_to(m.defs.window_end, "last_purchase").alias("recency_days"),
    ).orderBy(F.desc("total_orders"), "customer_unique_id", "purchase_seq").limit(top)


def purchase_gaps(orders: DataFrame) -> DataFrame:
    """Whole-day gaps between consecutive orders as a histogram ``(gap_days, events)``.

    Orders of one customer and day are counted first: they give gaps of zero, and only one row per
    customer and day enters the window, however many orders a customer has.
    """
    days = orders.groupBy("customer_unique_id", "order_date").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("order_date").over(Window.partitionBy("customer_unique_id").orderBy("order_date"))
    gaps = days.withColumn("gap", big(F.date_diff("order_date", before)))
    cells = gaps.select(F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("gap_days"), (F.col("n") - 1).alias("events")),
        F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("bigint").alias("events")))))
    return (cells.where(F.col("gap_days").isNotNull() & (F.col("events") > 0))
            .groupBy("gap_days").agg(F.sum("events").alias("events")))


def repurchase_gap_summary(m: Market) -> DataFrame:
    gaps = purchase_gaps(analysis_orders(m))

    def within(days: int):
        return F.coalesce(F.sum(F.when(F.col("gap_days") <= days, F.col("events"))), F.lit(0))

    events = F.sum("events")
    return gaps.agg(
        big(F.coalesce(events, F.lit(0))).alias("repurchase_events"),
        F.round(ratio(F.sum(F.col("gap_days") * F.col("events")), events), 1).alias("mean_gap_days"),
        dbl(F.min("gap_days")).alias("min_gap_days"), dbl(F.max("gap_days")).alias("max_gap_days"),
        big(within(30)).alias("within_30_days"), big(within(90)).alias("within_90_days"),
        big(within(180)).alias("within_180_days"),
        rounded_pct(within(90), events).alias("pct_within_90_days"))


def _scored_people(m: Market) -> DataFrame:
    return customer_value(m).select(
        "customer_unique_id", cal.dates_to(m.defs.recency_date, "last_purchase").alias("recency_days"),
        F.col("orders").alias("frequency"), dbl("spend").alias("monetary"), cents("spend").alias("spend_cents"))


def _rfm_of(placed: DataFrame) -> DataFrame:
    """Scores of rows that know their places r_at and m_at among all."""
    r = ntile_at(F.col("r_at"), F.col("r_at_total"), 5)
    money = ntile_at(F.col("m_at"), F.col("m_at_total"), 5)
    scored = placed.select("customer_unique_id", "recency_days", "frequency", "monetary", r.alias("r_score"),
                           frequency_score("frequency").alias("f_score"), money.alias("m_score"))
    return scored.withColumn("rfm_cell", F.concat_ws("-", "r_score", "f_score", "m_score"))


def ntile_rfm(m: Market) -> DataFrame:
    """Equal-count R and M scores and the rule-based F score for every customer."""
    people = _scored_people(m)
    n = people.count()
    by_recency = row_positions(people, "recency_days", "customer_unique_id", "r_at", descending=True, rows=n)
    return _rfm_of(row_positions(by_recency, "spend_cents", "customer_unique_id", "m_at", rows=n))


def customer_rfm_scores(m: Market, top: int = 20) -> DataFrame:
    """Scores of the customers who spent most. The few rows come first; one pass then counts who stands before each."""
    people = _scored_people(m)
    few = people.orderBy(F.desc("monetary"), "customer_unique_id").limit(top).collect()
    places = people.agg(
        F.count(F.lit(1)).alias("n"), F.array(*positions_of(people, few, "recency_days", "customer_unique_id", True)).cast("array<bigint>").alias("r"),
        F.array(*positions_of(people, few, "spend_cents", "customer_unique_id")).cast("array<bigint>").alias("m"))
    rows = people.sparkSession.createDataFrame(few, people.schema)
    numbered = rows.withColumn("at", F.row_number().over(everything().orderBy(F.desc("monetary"), "customer_unique_id")))
    seen = scalar(places, "n", "r", "m")
    placed = numbered.withColumns({"r_at": F.get(seen["r"], F.col("at") - 1), "m_at": F.get(seen["m"], F.col("at") - 1),
                                   "r_at_total": seen["n"], "m_at_total": seen["n"]})
    return _rfm_of(placed).orderBy(F.desc("monetary"), "customer_unique_id")


def revenue_concentration_by_customer_decile(m: Market) -> DataFrame:
    """Equal-count spend deciles, from the spend histogram alone."""
    spend = customer_value(m).select(cents("spend").alias("spend"))
    slices = tile_slices(histogram(spend, "spend"), "spend", 10, descending=True)
    deciles = slices.groupBy(F.col("tile").alias("spend_decile")).agg(
        F.sum("in_tile").alias("customers"), F.min("spend").alias("low"),
        (F.sum((F.col("spend") * F.col("in_tile")).cast("decimal(38,0)")).cast("double") / 100).alias("revenue"))
    running = everything().orderBy("spend_decile").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("revenue").over(everything())
    return deciles.select(
        "spend_decile", "customers", F.round("revenue", 2).alias("revenue"),
        rounded_pct("revenue", whole).alias("pct_of_revenue"),
        rounded_pct(F.sum("revenue").over(running), whole).alias("cumulative_pct"),
        F.round(ratio("revenue", "customers"), 2).alias("avg_spend"),
        F.round(F.col("low") / 100.0, 2).alias("min_spend")).orderBy("spend_decile")


def new_vs_returning_by_month(m: Market) -> DataFrame:
    """First-month orders against later ones.

    Orders are summed per customer and month first, so the window over a customer holds one row
    per month.
    """
    cells = order_revenue(m).groupBy("customer_unique_id", "order_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))
    cohort = F.min("order_month").over(Window.partitionBy("customer_unique_id"))
    is_new = F.col("order_month") == F.col("cohort_month")

    def part(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    return cells.withColumn("cohort_month", cohort).groupBy("order_month").agg(
        big(part(is_new, "orders")).alias("new_customer_orders"),
        big(part(~is_new, "orders")).alias("returning_orders"),
        dbl(part(is_new, "revenue")).alias("new_revenue"),
        dbl(part(~is_new, "revenue")).alias("returning_revenue"),
        rounded_pct(part(~is_new, "revenue"), F.sum("revenue")).alias("returning_revenue_pct"),
    ).orderBy("order_month")


CUSTOMER_QUERIES = {f.__name__: f for f in (
    top_customers_ranked, repeat_vs_one_time, order_frequency_distribution,
    first_and_last_purchase_per_customer, repurchase_gap_summary, customer_rfm_scores,
    revenue_concentration_by_customer_decile, new_vs_returning_by_month)}
