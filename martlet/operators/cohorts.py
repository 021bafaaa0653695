"""Cohorts by first-order month and what becomes of them.

Everything starts from one row per person and month, so a person's whole history is a handful of
rows however many orders it holds, distinct customers are plain counts, and one window per person
finds the cohort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.calendar import month_from_index, month_index
from martlet.functions.numbers import big, pct, ratio, total
from martlet.functions.windows import everything


def cohort_cells(orders: DataFrame) -> DataFrame:
    """(person, month) with order count, revenue, cohort month index and age in months."""
    monthly = orders.groupBy("customer_unique_id", month_index("order_timestamp").alias("month_index")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))
    cohort = F.min("month_index").over(Window.partitionBy("customer_unique_id"))
    return monthly.withColumn("cohort", cohort).withColumn("age", F.col("month_index") - F.col("cohort"))


def retention_matrix(orders: DataFrame) -> DataFrame:
    """Long matrix: customers and retention per cohort and age; absent cells stay absent."""
    cells = cohort_cells(orders).groupBy("cohort", "age").agg(F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("age") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("cohort_size", size).select(
        month_from_index("cohort").alias("cohort_month"), big("age").alias("age"), "customers",
        big("cohort_size").alias("cohort_size"), F.round(pct("customers", "cohort_size"), 4).alias("retention_pct"))


def retention_pivot(orders: DataFrame, last_age: int) -> DataFrame:
    """The matrix for display, one column per age."""
    return (retention_matrix(orders).groupBy("cohort_month").pivot("age", list(range(last_age + 1)))
            .agg(F.max("retention_pct")).select("cohort_month", *[F.col(str(k)).alias(f"m{k}") for k in range(last_age + 1)])
            .orderBy("cohort_month"))


def retention_curve(orders: DataFrame, zero_fill: bool = False, last_month_index: int | None = None) -> DataFrame:
    """Average retention by age over the cohorts that have a cell at that age.

    ``zero_fill`` also counts cohorts old enough for the age but with nobody left.
    """
    cells = retention_matrix(orders).where(F.col("age") > 0)
    if not zero_fill:
        return cells.groupBy(F.col("age").alias("month")).agg(
            F.round(F.avg(pct("customers", "cohort_size")), 4).alias("retention_pct"),
            F.count(F.lit(1)).alias("cohorts")).orderBy("month")
    if last_month_index is None:
        raise ValueError("zero_fill needs the last observed month")
    cohorts = cohort_cells(orders).where(F.col("age") == 0).groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    old_enough = F.sequence(F.lit(1).cast("bigint"), (F.lit(last_month_index) - F.col("cohort")).cast("bigint"))
    spine = cohorts.where(F.col("cohort") < last_month_index).select(
        month_from_index("cohort").alias("cohort_month"), F.explode(old_enough).alias("age"))
    filled = spine.join(cells.select("cohort_month", "age", pct("customers", "cohort_size").alias("p")),
                        ["cohort_month", "age"], "left")
    return filled.groupBy(F.col("age").alias("month")).agg(
        F.round(F.avg(F.coalesce("p", F.lit(0.0))), 4).alias("retention_pct"),
        F.count(F.lit(1)).alias("cohorts")).orderBy("month")


def cohort_summary(orders: DataFrame, last_month_index: int, horizon: int = 3) -> DataFrame:
    """Size, revenue, repeat rates and observation time per cohort.

    A cohort watched for less than the horizon gets no fixed-horizon rate; one with no repeater
    gets zero.
    """
    people = cohort_cells(orders).groupBy("cohort", "customer_unique_id").agg(
        F.sum("revenue").alias("revenue"), F.max("age").alias("last_age"),
        F.max(F.col("age").between(1, horizon)).alias("within"))
    groups = people.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("new_customers"), total("revenue").alias("revenue"),
        F.count_if("within").alias("within"), F.count_if(F.col("last_age") > 0).alias("ever"))
    observed = F.lit(last_month_index) - F.col("cohort")
    return groups.select(
        month_from_index("cohort").alias("cohort_month"), "new_customers", "revenue",
        F.round(ratio("revenue", "new_customers"), 4).alias("revenue_per_customer"),
        F.when(observed >= horizon, F.round(pct("within", "new_customers"), 4)).alias(f"repeat_rate_{horizon}mo_pct"),
        F.round(pct("ever", "new_customers"), 4).alias("ever_repeated_pct"),
        big(observed).alias("months_observed")).orderBy("cohort_month")


def fair_comparison(orders: DataFrame, last_month_index: int, horizon: int = 3) -> DataFrame:
    """Repeat rate within a fixed horizon, only for cohorts observed that long."""
    people = cohort_cells(orders).groupBy("cohort", "customer_unique_id").agg(
        F.max(F.col("age").between(1, horizon)).alias("within"))
    groups = people.where(F.lit(last_month_index) - F.col("cohort") >= horizon).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("cohort_size"), F.count_if("within").alias("repeated_within_horizon"))
    return groups.select(
        month_from_index("cohort").alias("cohort_month"), "cohort_size", "repeated_within_horizon",
        F.round(pct("repeated_within_horizon", "cohort_size"), 4).alias("repeat_rate_pct")).orderBy("cohort_month")


def fair_trend(orders: DataFrame, last_month_index: int, horizon: int = 3, edge: int = 6) -> DataFrame:
    """Linear trend of the fair rates over cohorts, and early against late cohorts."""
    rates = fair_comparison(orders, last_month_index, horizon)
    ordered = everything().orderBy("cohort_month")
    placed = rates.withColumns({"at": F.row_number().over(ordered) - 1, "n": F.count(F.lit(1)).over(everything())})
    y, x = F.col("repeat_rate_pct"), F.col("at").cast("double")
    return placed.agg(
        F.count(F.lit(1)).alias("cohorts"), F.round(F.avg(y), 4).alias("mean_pct"),
        F.round(F.regr_slope(y, x), 6).alias("slope_pp_per_cohort"), F.round(F.regr_intercept(y, x), 6).alias("intercept_pct"),
        F.round(F.avg(F.when(F.col("at") < edge, y)), 4).alias("early_mean_pct"),
        F.round(F.avg(F.when(F.col("at") >= F.col("n") - edge, y)), 4).alias("late_mean_pct"))


def censoring(orders: DataFrame, last_month_index: int) -> DataFrame:
    """How strongly the naive repeat rate (more than one order ever) follows observation time."""
    people = cohort_cells(orders).groupBy("cohort", "customer_unique_id").agg(F.sum("orders").alias("orders"))
    naive = people.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("cohort_size"), F.try_divide(
            100.0 * F.count_if(F.col("orders") > 1).cast("double"), F.count(F.lit(1)).cast("double")).alias("rate"))
    months = (F.lit(last_month_index) - F.col("cohort")).cast("double")
    return naive.agg(F.count(F.lit(1)).alias("cohorts"), F.round(F.avg("rate"), 4).alias("mean_rate_pct"),
                     F.round(F.corr(months, F.col("rate")), 6).alias("correlation"),
                     F.round(F.regr_slope("rate", months), 6).alias("slope"))


def revenue_retention(orders: DataFrame) -> DataFrame:
    """Revenue per cohort and age against the revenue of month zero."""
    cells = cohort_cells(orders).groupBy("cohort", "age").agg(F.sum("revenue").alias("revenue"))
    first = F.max(F.when(F.col("age") == 0, F.col("revenue"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("first", first).select(
        month_from_index("cohort").alias("cohort_month"), big("age").alias("age"),
        F.col("revenue").cast("double").alias("revenue"), F.round(pct("revenue", "first"), 4).alias("pct_of_month_0"))


def later_revenue_share(orders: DataFrame) -> DataFrame:
    cells = cohort_cells(orders)
    first, later = (total(F.when(c, F.col("revenue")).otherwise(0)) for c in (F.col("age") == 0, F.col("age") > 0))
    return cells.agg(first.alias("first_month_revenue"), later.alias("later_revenue")).withColumn(
        "later_share_pct", F.round(pct("later_revenue", F.col("first_month_revenue") + F.col("later_revenue")), 4))
