"""The data behind five dashboard pages: measures by axis under the page's slicers.

Each dataset takes the export tables (``martlet.plans.exports``) and a slicer predicate; layout and drawing are left to the
front end. ``page_rows`` gives all charts of a page at once: the charts of one table are the grouping sets of one aggregation,
so a page reads each of its tables once however many charts it shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.plans import measures
from martlet.plans.measures import page_dataset

Tables = Mapping[str, DataFrame]
Dataset = Callable[[Tables, Column | None, Definitions], DataFrame]


def _pick(found: Mapping[str, Column], *names: str) -> dict[str, Column]:
    return {n: found[n] for n in names}


@dataclass(frozen=True)
class Chart:
    """Measures of one table by the values of an axis; no axis gives cards."""

    table: str
    axis: tuple[str, ...]
    names: tuple[str, ...]
    order: Callable[[], list] = list

    def __call__(self, tables: Tables, slicer: Column | None, defs: Definitions) -> DataFrame:
        found = measures.measure_registry(defs)[self.table]
        return page_dataset(tables[self.table], self.axis, _pick(found, *self.names), slicer, self.order())

    def parts(self) -> tuple[Chart, ...]:
        return (self,)


@dataclass(frozen=True)
class Paired:
    """Two charts with the same axis, side by side; the slicer applies to the second."""

    first: Chart
    second: Chart

    def __call__(self, tables: Tables, slicer: Column | None, defs: Definitions) -> DataFrame:
        return self.first(tables, None, defs).join(self.second(tables, slicer, defs), list(self.first.axis))

    def parts(self) -> tuple[Chart, ...]:
        return (self.first, self.second)


def _orders(axis: tuple[str, ...], names: tuple[str, ...], order: Callable[[], list] = list) -> Chart:
    return Chart("fact_orders", axis, names, order)


def _items(axis: tuple[str, ...], names: tuple[str, ...], order: Callable[[], list] = list) -> Chart:
    return Chart("fact_order_items", axis, names, order)


def _people(axis: tuple[str, ...], names: tuple[str, ...], order: Callable[[], list] = list) -> Chart:
    return Chart("dim_customers_segmented", axis, names, order)


def _table(name: str, columns: tuple[str, ...], order: Callable[[], list]) -> Dataset:
    """A detail table in display order, with all its rows; a caller may page."""
    return lambda t, s, d: t[name].select(*columns).orderBy(*order())


# Pages, datasets and the measures they show.
PAGES: dict[str, dict[str, Dataset]] = {
    "overview": {
        "cards": _orders((), ("Total Revenue", "Orders", "Customers", "Late Rate %", "Avg Review Score", "AOV (Mean)", "One-Star Rate %")),
        "median_card": lambda t, s, d: measures.median_order_value(t["fact_orders"] if s is None else t["fact_orders"].where(s)),
        "monthly_trend": _orders(("order_month",), ("Revenue (Trend)",), lambda: ["order_month"]),
        "revenue_by_state": _orders(("customer_state",), ("Total Revenue",), lambda: [F.desc("Total Revenue"), "customer_state"]),
        "revenue_by_category": _items(("category",), ("Item Revenue",), lambda: [F.desc("Item Revenue"), "category"]),
    },
    "customers": {
        "cards": _people((), ("Segment Customers", "Repeat Rate %", "Repeat Customers", "Avg Customer Value")),
        "revenue_by_rfm": _people(("rfm_segment",), ("Segment Revenue",), lambda: [F.desc("Segment Revenue"), "rfm_segment"]),
        "revenue_by_cluster": _people(("kmeans_segment",), ("Segment Revenue",), lambda: [F.desc("Segment Revenue"), "kmeans_segment"]),
        "retention": Chart("fact_cohort_retention", ("months_since_first_purchase",), ("Retention % After Month 0",),
                           lambda: ["months_since_first_purchase"]),
        "fair_cohorts": Chart("dim_cohort_summary", ("cohort_month",), ("3-Month Repeat Rate %",), lambda: ["cohort_month"]),
    },
    "products": {
        "cards": _items((), ("Item Revenue", "Products Sold", "Items Sold", "Avg Item Price")),
        "momentum": Chart("dim_category_performance", ("category",), ("Category Momentum",),
                          lambda: [F.desc_nulls_last("Category Momentum"), "category"]),
        "price_and_volume": Paired(Chart("dim_category_performance", ("category",), ("Category Units", "Category Avg Price")),
                                   _items(("category",), ("Item Revenue",))),
        "best_products": _table("dim_product_performance", ("revenue_rank", "category", "units", "avg_item_price", "revenue",
                                                            "cumulative_pct_of_revenue"), lambda: ["revenue_rank"]),
    },
    "marketing": {
        "cards": _orders((), ("Total Revenue", "AOV (Mean)", "Late Rate %", "Avg Review Score")),
        "revenue_by_payment": _orders(("payment_type",), ("Total Revenue",), lambda: [F.desc("Total Revenue"), "payment_type"]),
        "value_by_instalments": _orders(("max_installments",), ("AOV (Credit Card)",), lambda: ["max_installments"]),
        "states": _table("dim_region_performance", ("customer_state", "orders", "aov", "avg_delivery_days", "late_rate_pct", "avg_review_score"),
                         lambda: [F.desc("orders"), "customer_state"]),
        "sellers": _table("dim_seller_performance", ("seller_id", "seller_state", "orders_n", "revenue", "late_rate_pct", "avg_review_score"),
                          lambda: [F.desc("revenue"), "seller_id"]),
    },
    "forecast": {
        "cards": lambda t, s, d: measures.next_month(t["fact_revenue_forecast"]),
        "history_and_forecast": Chart("fact_revenue_forecast", ("period_label",),
                                      ("Actual Revenue", "Forecast Revenue", "Forecast Lower 95", "Forecast Upper 95"), lambda: ["period_label"]),
        "models": _table("dim_forecast_model_comparison", ("model", "MAE", "RMSE", "MAPE_pct", "vs_naive_pct"), lambda: ["MAE", "model"]),
    },
}


def page(name: str, tables: Tables, defs: Definitions = Definitions(), slicers: Mapping[str, Column] | None = None) -> dict[str, DataFrame]:
    """All datasets of a page. ``slicers`` maps a dataset name to its predicate; others are unfiltered."""
    chosen = slicers or {}
    return {key: dataset(tables, chosen.get(key), defs) for key, dataset in PAGES[name].items()}


def sliced(tables: Tables, slicers: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Tables under a page's slicers; a slicer of the orders also keeps only the lines of the orders it keeps."""
    kept = {name: frame.where(slicers[name]) if name in slicers else frame for name, frame in tables.items()}
    if "fact_orders" in slicers and "fact_order_items" in kept:
        kept["fact_order_items"] = kept["fact_order_items"].join(kept["fact_orders"].select("order_id"), "order_id", "left_semi")
    return kept


def _grouped(table: DataFrame, charts: list[tuple[str, Chart]], found: Mapping[str, Column]) -> DataFrame:
    """Charts of one table as (dataset, axis_value, measure, value), from one aggregation."""
    axes = sorted({a for _, c in charts for a in c.axis})
    names = sorted({n for _, c in charts for n in c.names})
    aggregates = [found[n].cast("double").alias(n) for n in names]
    if axes:
        sets = sorted({c.axis for _, c in charts})
        out = table.groupingSets([list(s) for s in sets], *axes).agg(*aggregates, F.grouping_id().alias("_set"))
    else:
        out = table.agg(*aggregates).withColumn("_set", F.lit(0))

    def rows(dataset: str, chart: Chart) -> Column:
        # The grouping id has a bit for each axis that is summed over, the first axis highest.
        here = sum(1 << (len(axes) - 1 - i) for i, a in enumerate(axes) if a not in chart.axis)
        axis = F.concat_ws(" | ", *[F.col(a).cast("string") for a in chart.axis]) if len(chart.axis) > 1 else (
            F.col(chart.axis[0]).cast("string") if chart.axis else F.lit(None).cast("string"))
        made = F.array(*[F.struct(F.lit(dataset).alias("dataset"), axis.alias("axis_value"), F.lit(n).alias("measure"), F.col(n).alias("value")) for n in chart.names])
        return F.when(F.col("_set") == here, made).otherwise(F.slice(made, 1, 0))
    return out.select(F.inline(F.concat(*[rows(d, c) for d, c in charts])))


def page_rows(name: str, tables: Tables, defs: Definitions = Definitions(), slicers: Mapping[str, Column] | None = None,
              datasets: Iterable[str] | None = None) -> DataFrame:
    """All measure charts of a page under its slicers (one predicate per table): dataset, axis_value, measure, value.

    Only ``datasets`` if given; detail tables and frame measures stay in ``page``. A missing axis value is a row with a NULL
    ``axis_value``, as are cards. An empty table that has charts with an axis gives no rows.
    """
    wanted = set(PAGES[name] if datasets is None else datasets)
    by_table: dict[str, list[tuple[str, Chart]]] = {}
    for dataset, made in PAGES[name].items():
        if dataset in wanted and isinstance(made, Chart | Paired):
            for chart in made.parts():
                by_table.setdefault(chart.table, []).append((dataset, chart))
    found, kept = measures.measure_registry(defs, one_row_per_order=True), sliced(tables, slicers or {})
    return reduce(DataFrame.unionByName, [_grouped(kept[t], charts, found[t]) for t, charts in by_table.items()])
