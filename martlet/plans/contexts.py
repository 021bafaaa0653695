"""Measures in context: what a measure reads is a value that can be changed before the table is summed.

A context is the axis value and the slicers that hold where a measure is shown. A measure may add a filter to it, remove
or replace what is said about a column, or look months back. ``evaluate`` gathers what all measures read under several
axes, takes it from one scan (an aggregation over grouping sets, one set per level that some context needs) and brings
the coarser levels and other months to the axis values by windows over the summed rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.functions.numbers import cents, growth_pct, ratio
from martlet.operators.ordered import exact_quantiles

#: Copies of a grand total, so axis values need not meet in one task to see it.
COPIES = 64


@dataclass(frozen=True)
class Context:
    """Changes to the context. Filters are SQL conditions; ``months`` moves the month, whose slicer then no longer holds."""

    added: tuple[str, ...] = ()
    removed: frozenset[str] = frozenset()
    everything: bool = False
    months: int = 0

    def keep(self, condition: str) -> Context:
        """Also this condition: it narrows what axis and slicers say."""
        return replace(self, added=(*self.added, condition))

    def without(self, *columns: str) -> Context:
        """Neither axis nor slicers of these columns; of none at all if no column is named."""
        return replace(self, removed=self.removed | set(columns), everything=self.everything or not columns)

    def instead(self, column: str, condition: str) -> Context:
        """This condition in place of what axis and slicers say about the column."""
        return self.without(column).keep(condition)

    def shifted(self, months: int) -> Context:
        return replace(self, months=self.months + months)

    def level(self, axis: Sequence[str]) -> tuple[str, ...]:
        return () if self.everything else tuple(a for a in axis if a not in self.removed)

    def slicers(self, given: Mapping[str, Column], month: str) -> set[str]:
        return set() if self.everything else {c for c in given if c not in self.removed and not (self.months and c == month)}


HERE = Context()


@dataclass(frozen=True)
class Sum:
    column: str

    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.sum(kept(F.col(self.column)))


@dataclass(frozen=True)
class Average(Sum):
    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.avg(kept(F.col(self.column)))


@dataclass(frozen=True)
class Count(Sum):
    """Rows with a value."""

    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.count(kept(F.col(self.column)))


@dataclass(frozen=True)
class Rows:
    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.count(kept(F.lit(1)))


@dataclass(frozen=True)
class Distinct(Sum):
    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.countDistinct(kept(F.col(self.column)))


@dataclass(frozen=True)
class First:
    """The value of a column in the row that is lowest by another."""

    column: str
    by: str

    def over(self, kept: Callable[[Column], Column]) -> Column:
        return F.min_by(kept(F.col(self.column)), kept(F.col(self.by)))


Aggregate = Sum | Rows | First
#: Gives the value of an aggregate in a context, as a column for the measure's expression.
Look = Callable[..., Column]
Measure = Callable[[Look], Column]


def _of(numerator: Aggregate, denominator: Aggregate, context: Context = HERE, among: Context = HERE) -> Measure:
    return lambda at: ratio(at(numerator, context), at(denominator, among))


def _plain(aggregate: Aggregate, context: Context = HERE, unit: float = 1.0) -> Measure:
    return lambda at: at(aggregate, context).cast("double") / unit


def _month_on_month(at: Look) -> Column:
    whole = HERE.instead("is_truncated_period", "NOT is_truncated_period")
    growth = growth_pct(at(Sum("revenue"), whole), at(Sum("revenue"), whole.shifted(-1))) / 100.0
    return F.when(at(Rows(), HERE.instead("is_truncated_period", "is_truncated_period")) == 0, growth)


def measures_of(defs: Definitions = Definitions()) -> dict[str, dict[str, Measure]]:
    """Table -> measure. The order fact has one row per order; the exact median is a frame function of its own."""
    revenue, orders, card = Sum("revenue"), Count("order_id"), HERE.keep(f"payment_type = '{defs.instalment_payment}'")
    people, repeat, ahead = Rows(), HERE.keep("is_repeat_customer"), HERE.instead("type", "type = 'forecast'")
    return {
        "fact_orders": {
            "Total Revenue": _plain(revenue), "Revenue (Trend)": _plain(revenue, HERE.instead("is_truncated_period", "NOT is_truncated_period")),
            "Revenue MoM %": _month_on_month, "Total Freight": _plain(Sum("freight")), "Freight % of Revenue": _of(Sum("freight"), revenue),
            "Orders": _plain(orders), "Customers": _plain(Distinct("customer_unique_id")), "AOV (Mean)": _of(revenue, orders),
            "AOV (Credit Card)": _of(revenue, orders, card, card), "Multi-Item Order %": _of(orders, orders, HERE.keep("is_multi_item")),
            "Late Rate %": _of(orders, orders, HERE.keep("is_late")), "Avg Delivery Days": _plain(Average("delivery_days")),
            "Avg Review Score": _plain(Average("review_score")), "One-Star Rate %": _of(Rows(), Count("review_score"), HERE.keep("review_score = 1"))},
        "fact_order_items": {
            "Item Revenue": _plain(revenue), "Items Sold": _plain(Rows()), "Products Sold": _plain(Distinct("product_id")), "Avg Item Price": _of(revenue, Rows())},
        "dim_customers_segmented": {
            "Segment Customers": _plain(people), "Segment Revenue": _plain(Sum("monetary_revenue")), "Repeat Customers": _plain(people, repeat),
            "Repeat Rate %": _of(people, people, repeat), "Avg Customer Value": _of(Sum("monetary_revenue"), people),
            "Segment Revenue %": _of(Sum("monetary_revenue"), Sum("monetary_revenue"), among=HERE.without())},
        "fact_cohort_retention": {
            "Avg Retention %": _plain(Average("retention_pct"), unit=100.0),
            "Retention % After Month 0": _plain(Average("retention_pct"), HERE.keep("months_since_first_purchase > 0"), 100.0)},
        "dim_cohort_summary": {"3-Month Repeat Rate %": _plain(Average("repeat_rate_3mo_pct"), unit=100.0)},
        "dim_category_performance": {
            "Category Momentum": _plain(Sum("momentum_change_brl")), "Category Units": _plain(Sum("units")), "Category Avg Price": _plain(Average("avg_item_price"))},
        "fact_revenue_forecast": {
            "Actual Revenue": _plain(Sum("actual")), "Forecast Revenue": _plain(Sum("forecast")), "Forecast Lower 95": _plain(Sum("lower_95")),
            "Forecast Upper 95": _plain(Sum("upper_95")), "Next Month Forecast": _plain(First("forecast", "period"), ahead),
            "Next Month Lower 95": _plain(First("lower_95", "period"), ahead),
            "Next Month Upper 95": _plain(First("upper_95", "period"), ahead)},
    }


def evaluate(table: DataFrame, axes: Sequence[Sequence[str]], measures: Mapping[str, Measure], slicers: Mapping[str, Column] | None = None,
             month: str = "order_month") -> DataFrame:
    """Measures by the values of several axes: axis, axis_value, measure, value.

    ``slicers`` has a condition per column. An axis value is shown where some row meets all slicers; a missing one has a NULL
    ``axis_value``, as has the axis without columns, whose name is empty. A shifted measure needs the month (yyyy-MM) in the
    axis and is NULL elsewhere and where the other month has no row.
    """
    given, terms = dict(slicers or {}), {}

    def look(aggregate: Aggregate, context: Context = HERE) -> Column:
        return F.col(terms.setdefault((aggregate, context), f"_term_{len(terms)}"))

    shown = {name: measure(look) for name, measure in measures.items()}
    contexts = list(dict.fromkeys(c for _, c in terms))
    used = [c.slicers(given, month) for c in [HERE, *contexts]]
    shared = set.intersection(*used)
    kept = reduce(DataFrame.where, [given[c] for c in sorted(shared)], table)

    def under(context: Context) -> Callable[[Column], Column]:
        held = [given[c] for c in sorted(context.slicers(given, month) - shared)] + [F.expr(a) for a in context.added]
        return (lambda value: F.when(reduce(and_, held), value)) if held else lambda value: value

    columns = list(dict.fromkeys(a for axis in axes for a in axis))
    levels = [tuple(axis) for axis in axes] + [c.level(axis) for axis in axes for c in contexts]
    sets = {level: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level) for level in levels}
    taken = [aggregate.over(under(context)).alias(name) for (aggregate, context), name in terms.items()]
    taken.append(F.count(under(HERE)(F.lit(1))).alias("_here"))
    # The axis columns are copied, since a grouping column is NULL in the sets without it.
    keyed = kept.withColumns({f"_axis_{i}": F.col(c) for i, c in enumerate(columns)})
    keys = {c: f"_axis_{i}" for i, c in enumerate(columns)}
    if columns:
        distinct = {sets[level]: level for level in levels}.values()
        summed = keyed.groupingSets([[keys[c] for c in level] for level in distinct], *keys.values()).agg(*taken, F.grouping_id().alias("_set"))
    else:
        summed = keyed.agg(*taken).withColumn("_set", F.lit(0))

    def roles(level: tuple[str, ...]) -> Column:
        """The axes that a row of a level serves: as a value of the axis, or as what a context of it reads."""
        def serves(of: int, copies: Column) -> Column:
            return F.transform(copies, lambda copy: F.struct(F.lit(of).alias("_of"), copy.cast("bigint").alias("_copy")))

        made = []
        for i, axis in enumerate(map(tuple, axes)):
            if sets[axis] == sets[level]:
                made.append(serves(i, F.array(F.pmod(F.xxhash64(F.lit(0), *keys.values()), F.lit(COPIES)))))
            elif any(sets[c.level(axis)] == sets[level] for c in contexts):
                made.append(serves(i, F.array(F.lit(0)) if level else F.sequence(F.lit(0), F.lit(COPIES - 1))))
        return F.concat(*made)

    served = reduce(lambda other, level: F.when(F.col("_set") == sets[level], roles(level)).otherwise(other), dict.fromkeys(levels),
                    F.lit(None).cast("array<struct<_of:int,_copy:bigint>>"))
    rows = summed.select("*", F.inline(served))

    def by_axis(choose: Callable[[tuple[str, ...]], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("_of") == i, choose(tuple(axis))) for i, axis in enumerate(axes)])

    def brought(name: str, context: Context) -> Column:
        """A term at its context's level, on the rows of the axis."""
        at_level = by_axis(lambda axis: F.when(F.col("_set") == sets[context.level(axis)], F.col(name)))
        if context.months:
            if any(context.level(axis) != tuple(axis) for axis in axes):
                raise ValueError("a shifted context cannot remove a column of the axis")
            others = [F.col(k) for c, k in keys.items() if c != month]
            index = F.substring(keys[month], 1, 4).cast("int") * 12 + F.substring(keys[month], 6, 2).cast("int") if month in keys else F.lit(None).cast("int")
            with_month = F.col("_of").isin([i for i, axis in enumerate(axes) if month in axis])
            window = Window.partitionBy("_of", *others).orderBy(index).rangeBetween(context.months, context.months)
            return F.when(with_month & index.isNotNull(), F.max(at_level).over(window))
        parts = [by_axis(lambda axis, c=c, k=k: F.when(F.lit(c in context.level(axis)), F.col(k))) for c, k in keys.items()]
        copy = by_axis(lambda axis: F.when(F.lit(not context.level(axis) and bool(axis)), F.col("_copy")))
        return F.max(at_level).over(Window.partitionBy("_of", *parts, copy))

    moved = {name: brought(name, context) for (_, context), name in terms.items()
             if context.months or any(context.level(axis) != tuple(axis) for axis in axes)}
    on_axis = by_axis(lambda axis: F.col("_set") == sets[axis]) & (F.col("_here") > 0)
    here = rows.withColumns(moved).where(on_axis) if moved else rows.where(on_axis)

    def label(axis: tuple[str, ...]) -> Column:
        texts = [F.col(keys[a]).cast("string") for a in axis]
        return texts[0] if len(texts) == 1 else F.concat_ws(" | ", *texts) if texts else F.lit(None).cast("string")

    cells = [F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value")) for name, value in shown.items()]
    return here.select(by_axis(lambda axis: F.lit(" | ".join(axis))).alias("axis"), by_axis(label).alias("axis_value"), F.inline(F.array(*cells)))


def medians(table: DataFrame, axes: Sequence[str], column: str, name: str) -> DataFrame:
    """The exact median of money by the values of several axes, as `evaluate` gives it: one scan, one histogram for all."""
    places = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("axis_value")) for a in axes])
    cells = table.select(F.inline(places), cents(column).alias("_cents"))
    found = exact_quantiles(cells, "_cents", {"value": 0.5}, ["axis", "axis_value"], unit=100)
    return found.select("axis", "axis_value", F.lit(name).alias("measure"), "value")
