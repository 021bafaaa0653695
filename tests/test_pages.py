"""Pages at once against their charts one by one."""

import pytest
from pyspark.sql import functions as F

from martlet.plans import pages

ORDERS = ("order_id int, customer_unique_id int, customer_state string, payment_type string, order_month string, revenue double, is_late boolean, "
          "review_score int, is_truncated_period boolean, freight double, is_multi_item boolean, delivery_days double, max_installments int")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, i % 7, [None, "A", "B"][i % 3], ["credit_card", "boleto", None][i % 4 % 3], f"2018-0{i % 5 + 1}", float(i), i % 4 == 0, i % 5 + 1,
             i % 5 == 4, 1.0, i % 2 == 0, 3.0, i % 4) for i in range(60)]
    items = [(i % 60, i % 11, ["x", "y", None][i % 3], float(i % 13), 1.0) for i in range(150)]
    return {"fact_orders": spark.createDataFrame(rows, ORDERS),
            "fact_order_items": spark.createDataFrame(items, "order_id int, product_id int, category string, revenue double, freight double"),
            "dim_category_performance": spark.createDataFrame(
                [("x", 5.0, 3, 1.0), ("y", None, 4, 2.0)], "category string, momentum_change_brl double, units int, avg_item_price double")}


def long_rows(frame, axis):
    names = [c for c in frame.columns if c not in axis]
    return {(str(r[axis[0]]) if axis and r[axis[0]] is not None else None, n): r[n] for r in frame.collect() for n in names}


@pytest.mark.parametrize("name", ["overview", "products", "marketing"])
def test_rows_equal_the_charts(tables, name):
    got: dict = {}
    for r in pages.page_rows(name, tables).collect():
        at = got.setdefault(r["dataset"], {})
        assert (r["axis_value"], r["measure"]) not in at
        at[r["axis_value"], r["measure"]] = r["value"]
    for dataset, made in pages.PAGES[name].items():
        if not isinstance(made, pages.Chart | pages.Paired):
            assert dataset not in got
            continue
        want = {}
        for chart in made.parts():
            want |= long_rows(chart(tables, None, pages.Definitions()), chart.axis)
        assert got[dataset] == {k: (None if v is None else pytest.approx(float(v))) for k, v in want.items()}, dataset


def test_slicers_reach_the_lines(tables):
    keep = (F.col("customer_state") == "A") & (F.col("order_id") < 30)
    ids = {r["order_id"] for r in tables["fact_orders"].where(keep).collect()}
    want = sum(r["revenue"] for r in tables["fact_order_items"].collect() if r["order_id"] in ids)
    rows = pages.page_rows("overview", tables, slicers={"fact_orders": keep}).collect()
    assert sum(r["value"] or 0 for r in rows if r["dataset"] == "revenue_by_category") == pytest.approx(want)
    assert [r["value"] for r in rows if r["dataset"] == "cards" and r["measure"] == "Orders"] == [len(ids)]
    some = pages.page_rows("overview", tables, datasets=["cards"]).collect()
    assert {r["dataset"] for r in some} == {"cards"} and len(some) == 7


def test_a_table_is_read_once_and_may_be_empty(spark, tables, tmp_path):
    path = str(tmp_path / "orders")
    tables["fact_orders"].write.parquet(path)
    one = pages.page_rows("marketing", {"fact_orders": spark.read.parquet(path)})
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert pages.page_rows("marketing", empty).count() == 0
    assert len(pages.page("products", {**tables, "dim_product_performance": spark.createDataFrame(
        [(1, "x", 2, 1.0, 2.0, 50.0)], "revenue_rank int, category string, units int, avg_item_price double, revenue double, cumulative_pct_of_revenue double")})) == 4
