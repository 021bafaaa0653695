"""Customer features, repurchase gaps, lapse and risk, first-order experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions import calendar as cal
from martlet.functions.bands import edge_score
from martlet.functions.numbers import big, cents, fetched, mean, pct, ratio, scalar, share_true, total
from martlet.functions.windows import everything, running, share_of_all
from martlet.operators.ordered import exact_quantiles, running_before, share_curve

DAY_SECONDS = 86_400


def customer_features(orders: DataFrame, items: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """One row per person from the order and item facts.

    Breadth is counted on de-duplicated keys; both aggregations combine map-side, so no person's
    rows are ever gathered.
    """
    per_person = orders.groupBy("customer_unique_id").agg(
        F.min("order_timestamp").alias("first_order"), F.max("order_timestamp").alias("last_order"),
        F.count(F.lit(1)).alias("frequency"), F.sum("revenue").cast("decimal(18,2)").alias("monetary"),
        F.sum("freight").cast("decimal(18,2)").alias("total_freight"), F.sum("items_in_order").alias("total_items"),
        F.avg("review_score").alias("avg_review"), F.count_if("is_late").alias("late_orders"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        F.min_by("customer_state", F.when(F.col("customer_state").isNotNull(),
                                          F.struct("order_timestamp", "order_id"))).alias("state"))
    breadth = items.groupBy("customer_unique_id").agg(
        F.countDistinct("product_id").alias("n_distinct_products"), F.countDistinct("category").alias("n_categories"),
        F.countDistinct("seller_id").alias("n_sellers"))
    return per_person.join(breadth, "customer_unique_id", "left").withColumns({
        "recency": cal.whole_days_to(defs.recency_date, "last_order"),
        "tenure": cal.whole_days_to(defs.recency_date, "first_order"),
        "aov": ratio("monetary", "frequency"), "is_repeat": F.col("frequency") > 1,
        "late_rate": ratio("late_orders", "frequency")})


def gap_seconds(orders: DataFrame) -> DataFrame:
    """Histogram ``(gap_seconds, events)`` of the time between consecutive orders of a person.

    Equal timestamps are counted together. The order inside a day and the order of days are two
    windows, so a person with very many orders is cut into days: no window partition exceeds the
    seconds of a day or the days of the window.
    """
    who, ts = "customer_unique_id", F.col("order_timestamp")
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    cells = orders.groupBy(who, second.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("day", F.floor(F.col("at") / DAY_SECONDS))
    in_day = Window.partitionBy(who, "day").orderBy("at")
    gap = F.col("at") - F.lag("at").over(in_day)
    inside = cells.withColumn("gap", gap).select(F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("gap_seconds"), (F.col("n") - 1).alias("events")),
        F.struct(F.col("gap").alias("gap_seconds"), F.lit(1).cast("bigint").alias("events")))))
    days = cells.groupBy(who, "day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = days.select(
        (F.col("first") - F.lag("last").over(Window.partitionBy(who).orderBy("day"))).alias("gap_seconds"),
        F.lit(1).cast("bigint").alias("events"))
    return (inside.unionByName(across).where(F.col("gap_seconds").isNotNull() & (F.col("events") > 0))
            .groupBy("gap_seconds").agg(F.sum("events").alias("events")))


def _gap_quantiles(gaps: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles of a ready histogram, in days."""
    h = running_before(gaps.withColumnRenamed("events", "n"), "gap_seconds", ["n"])
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    picks, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n_total") - 1).cast("double")
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when(rank.between(first, last), F.col("gap_seconds"))).alias(f"{name}_{side}"))
        spot = F.lit(float(p)) * (F.col("total_n") - 1).cast("double")
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        outs.append(((low + (high - low) * (spot - F.floor(spot))) / F.lit(float(DAY_SECONDS))).alias(name))
    return h.agg(F.max("n_total").alias("total_n"), *picks).select(*outs)


def lapse_threshold(orders: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """One row: days of silence that outlast the given share of all repurchase gaps."""
    return _gap_quantiles(gap_seconds(orders), {"lapse_days": defs.lapse_quantile})


def repurchase_gap_table(orders: DataFrame, within: tuple[int, ...] = (7, 30, 60, 90, 180, 365)) -> DataFrame:
    """Repurchase events within a number of days, and their share."""
    gaps = gap_seconds(orders)
    row = gaps.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("all"), *[
        F.coalesce(F.sum(F.when(F.col("gap_seconds") <= d * DAY_SECONDS, F.col("events"))), F.lit(0)).alias(f"d{d}")
        for d in within])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(d).cast("bigint").alias("within_days"), big(f"d{d}").alias("events"),
                 F.round(pct(f"d{d}", "all"), 4).alias("pct_of_repurchases")) for d in within])))


def gap_distribution(orders: DataFrame) -> DataFrame:
    gaps = gap_seconds(orders)
    quartiles = _gap_quantiles(gaps, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    spread = scalar(quartiles, "p25", "p50", "p75", "p90")
    return gaps.agg(
        big(F.sum("events")).alias("events"),
        F.round(ratio(F.sum(F.col("gap_seconds") * F.col("events")), F.sum("events")) / DAY_SECONDS, 4).alias("mean_days"),
        F.round(F.min("gap_seconds") / F.lit(float(DAY_SECONDS)), 4).alias("min_days"),
        F.round(F.max("gap_seconds") / F.lit(float(DAY_SECONDS)), 4).alias("max_days"),
    ).select("*", *[F.round(spread[p], 4).alias(f"{p}_days") for p in ("p25", "p50", "p75", "p90")])


def with_risk(features: DataFrame, orders: DataFrame, defs: Definitions = Definitions()) -> DataFrame:
    """Lapsed flag and risk tier, from two fetched thresholds."""
    lapse = fetched(lapse_threshold(orders, defs), "lapse_days")["lapse_days"]
    top = fetched(exact_quantiles(features.select(cents("monetary").alias("c")), "c",
                                 {"value": defs.high_value_quantile}), "value")["value"]
    # Tier names.
    tier = (F.when(F.col("recency") <= defs.active_days, f"1. Active (bought in last {defs.active_days}d)")
            .when(F.col("recency") <= lapse, f"2. Cooling ({defs.active_days}d - lapse threshold)")
            .when(cents("monetary") >= top, "3. Lapsed - HIGH value (priority win-back)")
            .otherwise("4. Lapsed - low value"))
    return features.withColumns({"lapsed": F.col("recency") > lapse, "risk_tier": tier})


def lapse_status(customers: DataFrame) -> DataFrame:
    """Customers by repeat and lapsed status. Input needs ``with_risk``."""
    label = F.concat(F.when(F.col("is_repeat"), "repeat, ").otherwise("one-time, "),
                     F.when(F.col("lapsed"), "lapsed")
                     .otherwise(F.when(F.col("is_repeat"), "still active").otherwise("still within window")))
    groups = customers.groupBy(label.alias("status")).agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.round(mean("monetary"), 4).alias("avg_spend"), F.round(F.avg("recency"), 4).alias("avg_recency"))
    return groups.select("*", F.round(share_of_all("customers"), 4).alias("pct_of_customers"),
                         F.round(share_of_all("revenue"), 4).alias("pct_of_revenue"))


def risk_profile(customers: DataFrame) -> DataFrame:
    groups = customers.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.round(mean("monetary"), 4).alias("avg_spend"), F.round(F.avg("recency"), 4).alias("avg_recency"),
        F.round(100.0 * share_true("is_repeat"), 4).alias("repeat_rate"))
    return groups.select("*", F.round(share_of_all("customers"), 4).alias("pct_of_customers"),
                         F.round(share_of_all("revenue"), 4).alias("pct_of_revenue"))


def value_edges(customers: DataFrame, bins: int) -> list[Column]:
    """Inner quantile edges of spend, in cents, as literals."""
    probs = {f"e{k}": k / bins for k in range(1, bins)}
    edges = fetched(exact_quantiles(customers.select(cents("monetary").alias("c")), "c", probs), *probs)
    return [edges[name] for name in probs]


def with_value_decile(customers: DataFrame, bins: int = 10) -> DataFrame:
    """Decile by quantile edges: equal spend never splits."""
    return customers.withColumn("value_decile", edge_score(cents("monetary"), value_edges(customers, bins)))


def value_decile_table(customers: DataFrame) -> DataFrame:
    groups = customers.groupBy("value_decile").agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.min("monetary").cast("double").alias("min_spend"), F.max("monetary").cast("double").alias("max_spend"),
        F.round(mean("monetary"), 4).alias("avg_spend"), F.round(100.0 * share_true("is_repeat"), 4).alias("repeat_rate"))
    from_top = everything().orderBy(F.desc("value_decile"))
    return groups.select(
        "*", F.round(share_of_all("revenue"), 4).alias("pct_of_revenue"),
        F.round(F.try_divide(100.0 * running("revenue", from_top), F.sum("revenue").over(everything())), 4)
        .alias("cumulative_pct")).orderBy(F.desc("value_decile"))


def concentration(df: DataFrame, amount: str, at: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """Share of the amount that the top ``q`` percent of rows hold, one row per ``q``."""
    curve = share_curve(df.select(cents(amount).alias("c")), "c", at)
    return curve.select(F.inline(F.array(*[
        F.struct(F.lit(q).cast("bigint").alias("top_pct"), F.round(f"share_{q}", 4).alias("pct_of_amount")) for q in at])))


def first_orders(orders: DataFrame) -> DataFrame:
    """Per person: order count and, per column, the first value that is not missing.

    Columns are taken independently, so they can stem from different orders when a value of the
    very first order is missing.
    """
    at = F.struct("order_timestamp", "order_id")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)

    return orders.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"), first("is_late"), first("review_score"), first("delivery_days"),
    ).withColumn("came_back", F.col("orders") > 1)


def first_experience_by_lateness(orders: DataFrame) -> DataFrame:
    label = F.when(F.col("is_late"), "first order LATE").otherwise("first order on time")
    return first_orders(orders).groupBy(label.alias("first_experience")).agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("came_back").alias("came_back"),
        F.round(100.0 * share_true("came_back"), 4).alias("repeat_rate"),
        F.round(F.avg("review_score"), 4).alias("avg_review"), F.round(F.avg("delivery_days"), 4).alias("avg_delivery"))


def first_experience_by_score(orders: DataFrame) -> DataFrame:
    return first_orders(orders).na.drop(subset=["review_score"]).groupBy("review_score").agg(
        F.count(F.lit(1)).alias("customers"), F.round(100.0 * share_true("came_back"), 4).alias("repeat_rate"),
    ).orderBy("review_score")


def geography_profile(customers: DataFrame) -> DataFrame:
    """Customer profile per state, with the exact median spend."""
    middle = exact_quantiles(customers.select("state", cents("monetary").alias("c")), "c", {"median_spend": 0.5},
                             groups=["state"], unit=100)
    groups = customers.groupBy("state").agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.round(mean("monetary"), 4).alias("avg_spend"), F.round(100.0 * share_true("is_repeat"), 4).alias("repeat_rate"),
        F.round(F.avg("avg_review"), 4).alias("avg_review"), F.round(F.avg("avg_delivery_days"), 4).alias("avg_delivery"),
        F.round(100.0 * F.avg("late_rate"), 4).alias("late_rate"))
    return groups.withColumn("pct_of_revenue", F.round(share_of_all("revenue"), 4)).join(middle, "state").withColumn(
        "median_spend", F.round("median_spend", 4)).orderBy(F.desc("revenue"))


def frequency_table(customers: DataFrame) -> DataFrame:
    """Customers and revenue per order count."""
    return customers.groupBy("frequency").agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue")).select(
        "*", F.round(share_of_all("customers"), 4).alias("pct_of_customers"),
        F.round(share_of_all("revenue"), 4).alias("pct_of_revenue")).orderBy("frequency")


def repeat_comparison(customers: DataFrame) -> DataFrame:
    """One-time against repeat buyers."""
    kind = F.when(F.col("is_repeat"), "repeat buyers").otherwise("one-time buyers")
    return customers.groupBy(kind.alias("buyers")).agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.round(mean("monetary"), 4).alias("avg_lifetime_spend"), F.round(F.avg("aov"), 4).alias("avg_order_value"),
        F.round(F.avg("avg_review"), 4).alias("avg_review_score")).select(
        "*", F.round(share_of_all("customers"), 4).alias("pct_of_customers"),
        F.round(share_of_all("revenue"), 4).alias("pct_of_revenue"))

