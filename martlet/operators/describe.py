"""Descriptive statistics: profiles, shape, value counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.numbers import cents, pct, scalar
from martlet.operators.ordered import exact_quantiles


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population skewness."""
    x = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(x * (x - 1)) / (x - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population excess kurtosis."""
    x = n.cast("double")
    return F.when(n > 3, (x - 1) / ((x - 2) * (x - 3)) * ((x + 1) * g2 + 6))


def shape(df: DataFrame, columns: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, skewness and kurtosis per column, one row each."""
    keys, names = list(groups), list(columns)
    aggs = []
    for name, c in columns.items():
        x = c.cast("double")
        aggs += [F.count(x).alias(f"{name}__n"), F.avg(x).alias(f"{name}__m"), F.stddev_samp(x).alias(f"{name}__s"),
                 F.skewness(x).alias(f"{name}__g1"), F.kurtosis(x).alias(f"{name}__g2")]
    row = df.groupBy(*keys).agg(*aggs)
    cells = [F.struct(
        F.lit(name).alias("column"), F.col(f"{name}__n").alias("n"), F.round(f"{name}__m", 4).alias("mean"),
        F.round(f"{name}__s", 4).alias("std"),
        F.round(sample_skewness(F.col(f"{name}__g1"), F.col(f"{name}__n")), 4).alias("skew"),
        F.round(sample_kurtosis(F.col(f"{name}__g2"), F.col(f"{name}__n")), 4).alias("kurtosis")) for name in names]
    return row.select(*keys, F.inline(F.array(*cells)))


def describe_money(df: DataFrame, amount: str, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles of a money column, long form."""
    names = {f"p{round(p * 100)}": p for p in probs}
    marks = scalar(exact_quantiles(df.select(cents(amount).alias("c")), "c", names, unit=100), *names)
    x = F.col(amount).cast("double")
    row = df.agg(F.count(x).cast("double").alias("count"), F.round(F.try_divide(F.sum(amount).cast("double"), F.count(x).cast("double")), 4).alias("mean"),
                 F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    wide = row.select("*", *[F.round(marks[n], 4).alias(n) for n in names])
    return wide.unpivot([], wide.columns, "statistic", "value")


def below_mean_share(df: DataFrame, amount: str) -> DataFrame:
    """Share of rows below the mean."""
    middle = scalar(df.agg(F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double")).alias("m")), "m")["m"]
    return df.agg(F.round(100.0 * F.avg((F.col(amount).cast("double") < middle).cast("int")), 4).alias("below_mean_pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share; the total is a scalar, so a column of very many values needs no window."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rows = scalar(counts.agg(F.sum("n").alias("rows")), "rows")["rows"]
    return counts.withColumn("pct", F.round(pct("n", rows), 4)).orderBy(F.desc("n"), column)
