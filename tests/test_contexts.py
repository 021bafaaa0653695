"""Measures in context, against filters and sums by hand."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from martlet.functions.numbers import ratio
from martlet.plans import contexts
from martlet.plans.contexts import HERE, Average, Count, Distinct, First, Rows, Sum

ROWS = [("2020-01", "a", "x", 10.0), ("2020-01", "b", "y", 30.0), ("2020-02", "a", "x", 20.0), ("2020-02", "a", "y", None), ("2020-04", "b", "x", 5.0),
        ("2020-12", None, "x", 8.0), ("2021-01", "a", None, 16.0), (None, "b", "y", 1.0)]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(ROWS, "order_month string, shop string, kind string, v double").repartition(3)


def values(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["measure"] not in out[r["axis"], r["axis_value"]], "a value is shown once"
        out[r["axis"], r["axis_value"]][r["measure"]] = r["value"]
    return dict(out)


def total(**where):
    return sum(v or 0 for m, s, k, v in ROWS if all({"month": m, "shop": s, "kind": k}[n] == w for n, w in where.items()))


def test_every_aggregate_on_axes_and_cards(facts):
    shown = {"sum": lambda at: at(Sum("v")), "rows": lambda at: at(Rows()), "known": lambda at: at(Count("v")), "avg": lambda at: at(Average("v")),
             "kinds": lambda at: at(Distinct("kind")), "first": lambda at: at(First("v", "order_month"))}
    found = values(contexts.evaluate(facts, [("shop",), ("shop", "kind"), ()], shown))
    first = found["", None].pop("first")
    assert found["", None] == {"sum": 90.0, "rows": 8.0, "known": 7.0, "avg": pytest.approx(90 / 7), "kinds": 2.0} and first in (10.0, 30.0)
    assert found["shop", "a"]["sum"] == total(shop="a") and found["shop", "a"]["rows"] == 4 and found["shop", "a"]["first"] == 10.0
    assert found["shop", None]["sum"] == 8.0
    assert found["shop | kind", "b | y"]["sum"] == 31.0
    assert len([k for k in found if k[0] == "shop"]) == 3


def test_removed_filters_see_all_rows(facts):
    share = {"share": lambda at: ratio(at(Sum("v")), at(Sum("v"), HERE.without())), "of shop": lambda at: ratio(at(Sum("v")), at(Sum("v"), HERE.without("kind")))}
    found = values(contexts.evaluate(facts, [("shop",), ("shop", "kind"), ()], share, {"kind": F.col("kind") == "x"}))
    assert found["shop", "a"]["share"] == pytest.approx(30 / 90) and found["shop", "a"]["of shop"] == pytest.approx(30 / total(shop="a"))
    assert found["shop | kind", "b | x"] == {"share": pytest.approx(5 / 90), "of shop": pytest.approx(5 / total(shop="b"))}
    assert found["", None]["share"] == pytest.approx(43 / 90)
    assert ("shop | kind", "b | y") not in found, "only values under the slicers are shown"


def test_a_filter_narrows_or_replaces(facts):
    shown = {"narrow": lambda at: at(Sum("v"), HERE.keep("kind = 'x'")), "replace": lambda at: at(Sum("v"), HERE.instead("kind", "kind = 'x'"))}
    found = values(contexts.evaluate(facts, [("kind",)], shown))
    assert found["kind", "x"] == {"narrow": 43.0, "replace": 43.0}
    assert found["kind", "y"] == {"narrow": None, "replace": 43.0}
    assert found["kind", None] == {"narrow": None, "replace": 43.0}


def test_shift_goes_by_calendar_month_and_past_the_slicer(facts):
    shown = {"now": lambda at: at(Sum("v")), "before": lambda at: at(Sum("v"), HERE.shifted(-1))}
    found = values(contexts.evaluate(facts, [("order_month",), ("order_month", "shop"), ("shop",)], shown))
    assert found["order_month", "2020-02"] == {"now": 20.0, "before": 40.0}
    assert found["order_month", "2020-04"]["before"] is None, "a month after a gap has none before it"
    assert found["order_month", "2021-01"]["before"] == 8.0
    assert found["order_month", None] == {"now": 1.0, "before": None}
    assert found["order_month | shop", "2020-02 | a"]["before"] == 10.0
    assert found["shop", "a"]["before"] is None
    cut = values(contexts.evaluate(facts, [("order_month",)], shown, {"order_month": F.col("order_month") >= "2020-02"}))
    assert cut["order_month", "2020-02"]["before"] == 40.0 and ("order_month", "2020-01") not in cut


def test_empty_table_and_single_scan(spark, facts, tmp_path):
    share = {"share": lambda at: ratio(at(Sum("v")), at(Sum("v"), HERE.without())), "before": lambda at: at(Sum("v"), HERE.shifted(-1))}
    assert values(contexts.evaluate(facts.where("v > 99"), [("shop",)], {"s": lambda at: at(Sum("v"))})) == {}
    facts.write.parquet(str(tmp_path / "t"))
    plan = contexts.evaluate(spark.read.parquet(str(tmp_path / "t")), [("order_month",), ("shop",)], {"share": share["share"]})
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_all_named_measures_are_there():
    from martlet.plans import measures

    named = [n for table in contexts.measures_of().values() for n in table] + ["AOV (Median)"]
    old = [n for table in measures.measure_registry().values() for n in table] + measures.FRAME_MEASURES
    assert sorted(named) == sorted(old) and len(named) == 38
