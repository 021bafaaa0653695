"""Slices of the star: accepted values by column and a span of days, as one predicate that reaches the scan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.calendar import in_dates
from martlet.functions.numbers import total


class Slice:
    """Rows whose columns hold an accepted value: ``Slice(customer_state=("SP", "RJ"), since=date(2018, 1, 1))``.

    Each keyword names a column of the sliced rows; an empty list accepts everything. ``since`` and ``until`` are whole
    days, both included, of ``order_timestamp``. Rows with NULL in a sliced column go.
    """

    def __init__(self, since: date | None = None, until: date | None = None, **accepted: Iterable) -> None:
        if since and until and until < since:
            raise ValueError(f"the span ends on {until}, before it starts on {since}")
        self.since, self.until = since, until
        self.accepted = {column: tuple(values) for column, values in accepted.items()}

    def predicate(self) -> Column:
        tests = [F.col(column).isin(*values) for column, values in self.accepted.items() if values]
        return reduce(and_, tests, in_dates("order_timestamp", self.since, self.until))

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.predicate())


def in_quadrants(items: DataFrame, quadrants: DataFrame, names: Iterable[str]) -> DataFrame:
    """Items of the categories in the named quadrants (none named: all items).

    It narrows a slice by category: only categories that both accept stay, so disjoint choices leave no row.
    """
    names = list(names)
    if not names:
        return items
    return items.join(quadrants.where(F.col("quadrant").isin(*names)).select("category"), "category", "left_semi")


def requested_values(rows: DataFrame, column: str, requested: Iterable[str]) -> DataFrame:
    """filter, value, known: whether each requested value occurs in the column."""
    requested = sorted({str(v) for v in requested})
    asked = rows.sparkSession.createDataFrame([(v,) for v in requested], "value string")
    present = rows.select(F.col(column).cast("string").alias("value")).where(F.col("value").isin(*requested))
    present = present.groupBy("value").agg(F.lit(True).alias("known"))
    return asked.join(present, "value", "left").select(
        F.lit(column).alias("filter"), "value", F.coalesce("known", F.lit(False)).alias("known"))


def check_values(rows: DataFrame, column: str, requested: Iterable[str], label: str | None = None) -> None:
    """Raise when a requested value does not occur; only the unknown values are fetched."""
    unknown = [r.value for r in requested_values(rows, column, requested).where("not known").orderBy("value").collect()]
    if unknown:
        raise ValueError(f"unknown {label or column}: {', '.join(unknown)}")


def filter_domain(df: DataFrame, column: str, amount: str = "revenue") -> DataFrame:
    """Values a filter accepts, the largest amount first."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(total(amount).alias("amount")).select(F.lit(column).alias("filter"), "value", "amount")
            .orderBy(F.desc("amount"), "value"))


def date_domain(orders: DataFrame) -> DataFrame:
    return orders.agg(F.to_date(F.min("order_timestamp")).alias("date_min"),
                      F.to_date(F.max("order_timestamp")).alias("date_max"))
