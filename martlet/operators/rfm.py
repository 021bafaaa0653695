"""RFM scores by quantile edges, named segments, segment profiles and table agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.bands import edge_score, frequency_score
from martlet.functions.numbers import cents, fetched, mean, share_true, total
from martlet.functions.windows import everything, share_of_all
from martlet.operators.customers import value_edges
from martlet.operators.ordered import exact_quantiles


def with_rfm_scores(customers: DataFrame, bins: int = 5) -> DataFrame:
    """R and M by quantile edges, F by rule, and the cell and sum of the three."""
    probs = {f"e{k}": k / bins for k in range(1, bins)}
    recency = fetched(exact_quantiles(customers.select("recency"), "recency", probs), *probs)
    scored = customers.withColumns({
        "r_score": edge_score("recency", [recency[p] for p in probs], reverse=True),
        "f_score": frequency_score("frequency"),
        "m_score": edge_score(cents("monetary"), value_edges(customers, bins))})
    return scored.withColumns({
        "rfm_cell": F.concat_ws("-", "r_score", "f_score", "m_score"),
        "rfm_sum": F.col("r_score") + F.col("f_score") + F.col("m_score")})


def segment_name(r: Column, f: Column, m: Column) -> Column:
    """Named segments; the first rule that holds decides."""
    recent, big_spender, frequent = r >= 4, m >= 4, f >= 5
    # Segment names and rule order.
    return (F.when(frequent & recent & big_spender, "Champions")
            .when(frequent & (r >= 3), "Loyal")
            .when(frequent, "At Risk")
            .when(recent & big_spender, "Potential Loyalists")
            .when(recent, "New Customers")
            .when(r == 3, "Needs Attention")
            .when(big_spender, "At Risk")
            .otherwise("Lost"))


def with_rfm_segment(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rfm_segment", segment_name(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def segment_profile(customers: DataFrame, segment: str = "rfm_segment") -> DataFrame:
    groups = customers.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"), total("monetary").alias("revenue"),
        F.round(F.avg("recency"), 4).alias("avg_recency"), F.round(F.avg("frequency"), 4).alias("avg_frequency"),
        F.round(mean("monetary"), 4).alias("avg_monetary"), F.round(F.avg("aov"), 4).alias("avg_aov"),
        F.round(F.avg("avg_review"), 4).alias("avg_review"), F.round(100.0 * share_true("is_repeat"), 4).alias("repeat_rate"))
    return groups.select("*", F.round(share_of_all("customers"), 4).alias("pct_of_customers"),
                         F.round(share_of_all("revenue"), 4).alias("pct_of_revenue")).orderBy(F.desc("revenue"))


def score_bands(customers: DataFrame, score: str, measure: str) -> DataFrame:
    """Range and size of each score."""
    return customers.groupBy(score).agg(
        F.min(measure).cast("double").alias(f"{measure}_min"), F.max(measure).cast("double").alias(f"{measure}_max"),
        F.count(F.lit(1)).alias("customers")).orderBy(F.desc(score))


def score_grid(customers: DataFrame) -> DataFrame:
    """Revenue by R and M score as a pivot, R down and M across."""
    return (customers.groupBy("r_score").pivot("m_score", [1, 2, 3, 4, 5]).agg(total("monetary"))
            .select("r_score", *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"m_{k}") for k in range(1, 6)])
            .orderBy("r_score"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long contingency table with the row percentage."""
    from pyspark.sql import Window

    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    in_row = F.sum("n").over(Window.partitionBy(row))
    return cells.withColumn("row_pct", F.round(F.try_divide(100.0 * F.col("n").cast("double"), in_row.cast("double")), 4))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings.

    Computed from the contingency table, whose size is that of the two label sets.
    """
    from pyspark.sql import Window

    def pairs(n: Column) -> Column:
        x = n.cast("double")
        return x * (x - 1) / 2.0

    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({
        "na": F.sum("n").over(Window.partitionBy(a)), "nb": F.sum("n").over(Window.partitionBy(b)),
        "ra": F.row_number().over(Window.partitionBy(a).orderBy(b)),
        "rb": F.row_number().over(Window.partitionBy(b).orderBy(a)),
        "total": F.sum("n").over(everything())})

    def once(flag: str, value: Column) -> Column:
        return F.sum(F.when(F.col(flag) == 1, value).otherwise(0.0))

    def entropy(flag: str, n: str) -> Column:
        p = F.col(n) / F.col("total")
        return -once(flag, p * F.log(p))

    n, na, nb, whole = F.col("n"), F.col("na"), F.col("nb"), F.col("total")
    info = F.sum(n / whole * F.log(n.cast("double") * whole / (na.cast("double") * nb)))
    sums = cells.agg(F.sum(pairs(n)).alias("cell"), once("ra", pairs(na)).alias("a"), once("rb", pairs(nb)).alias("b"),
                     F.max(pairs(whole)).alias("all"), info.alias("mi"), entropy("ra", "na").alias("ha"),
                     entropy("rb", "nb").alias("hb"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("all"))
    index = F.try_divide(F.col("cell") - expected, (F.col("a") + F.col("b")) / 2.0 - expected)
    mutual = F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2.0)
    return sums.select(F.round(index, 6).alias("adjusted_rand_index"),
                       F.round(mutual, 6).alias("normalised_mutual_information"))
