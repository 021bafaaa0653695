"""Whole jobs on the smallest sample: reconciliation, filters, exports, round trips."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from martlet.config import Definitions
from martlet.operators import cohorts, customers, facts, filters, metrics
from martlet.plans import exports, measures
from martlet.plans.registry import all_queries
from martlet.plans.star import fact_order_items, fact_orders
from martlet.sources import raw, sample, storage
from martlet.sources.market import Market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    m = sample.sample_market(spark, SF)
    return m, fact_orders(m).cache(), fact_order_items(m).cache()


def test_default_definitions():
    d = Definitions()
    assert d.recent_span.months == ("2018-06", "2018-07", "2018-08") and d.prior_span.tag == "mar_may_2018"
    assert d.partial_quarter == ("2018Q3", "Jul+Aug") and d.partial_month == "2018-08" and d.recency_date == date(2018, 9, 1)
    assert d.last_month_index == 2018 * 12 + 8 and d.comparable_months == 8


def test_parts_sum_to_the_whole(spark, star):
    m, orders, items = star
    whole = metrics.kpis(orders).first()
    assert items.agg(F.sum("revenue").cast("double")).first()[0] == pytest.approx(whole["revenue"])
    states = metrics.revenue_by_state(orders).toPandas()
    assert states.revenue.sum() == pytest.approx(whole["revenue"]) and states.revenue_pct.sum() == pytest.approx(100, abs=0.01)
    two = filters.Slice(customer_state=("NATION_1", "NATION_2")).of(orders)
    one = [metrics.kpis(filters.Slice(customer_state=(s,)).of(orders)).first()["revenue"] for s in ("NATION_1", "NATION_2")]
    assert metrics.kpis(two).first()["revenue"] == pytest.approx(sum(one))


def test_facts_keep_every_row(spark, star):
    m, _, _ = star
    assert facts.orders_fact(m).count() == m.orders.count() and facts.order_items_fact(m).count() == m.items.count()


def test_filters_reject_and_match_nothing(spark, star):
    _, orders, items = star
    with pytest.raises(ValueError, match="MARS"):
        filters.check_values(orders, "customer_state", ["NATION_1", "MARS"], "state")
    with pytest.raises(ValueError):
        filters.Slice(since=date(2000, 1, 2), until=date(2000, 1, 1))
    quadrants = metrics.price_volume_quadrants(items, 1)
    inside = quadrants.where(F.col("quadrant").startswith("Premium")).first()["category"]
    none = filters.in_quadrants(filters.Slice(category=(inside,)).of(items), quadrants, ("Budget + low volume",))
    assert none.count() == 0
    day = date(1998, 5, 4)
    assert filters.Slice(since=day, until=day).of(orders).where(F.col("order_date") != F.lit(day)).count() == 0


def test_retention_invariants(spark, star):
    m, orders, _ = star
    cells = cohorts.retention_matrix(orders).toPandas()
    assert (cells[cells.age == 0].retention_pct == 100).all() and cells.customers.le(cells.cohort_size).all()
    assert cells[cells.age == 0].customers.sum() == orders.select("customer_unique_id").distinct().count()
    summary = cohorts.cohort_summary(orders, m.defs.last_month_index).toPandas()
    assert summary[summary.months_observed < 3].repeat_rate_3mo_pct.isna().all()
    assert summary[summary.months_observed >= 3].repeat_rate_3mo_pct.notna().all()


def test_gaps_match_a_plain_window(spark):
    rows = [("a", f"2020-01-0{d} 0{h}:00:00") for d, h in ((1, 1), (1, 1), (1, 5), (3, 2))] + [("b", "2020-02-01 00:00:00")]
    orders = spark.createDataFrame(rows, "customer_unique_id string, t string").select(
        "customer_unique_id", F.col("t").cast("timestamp_ntz").alias("order_timestamp"))
    got = {r.gap_seconds: r.events for r in customers.gap_seconds(orders).collect()}
    assert got == {0: 1, 4 * 3600: 1, 45 * 3600: 1}


def test_results_do_not_depend_on_partitioning(spark, star):
    m, orders, items = star
    again = metrics.kpis(orders.repartition(13, "order_id")).first()
    assert again == metrics.kpis(orders).first()
    assert metrics.product_pareto(items.repartition(11)).first() == metrics.product_pareto(items).first()


def test_measure_registry(spark, star):
    m, orders, items = star
    registry = measures.measure_registry(m.defs)
    names = [n for table in registry.values() for n in table] + measures.FRAME_MEASURES
    assert len(names) == len(set(names)) == 38
    shares = measures.segment_revenue_share(
        orders.groupBy("customer_unique_id", "customer_state").agg(F.sum("revenue").alias("monetary_revenue")), "customer_state")
    assert shares.agg(F.sum("Segment Revenue %")).first()[0] == pytest.approx(1.0)


def test_export_round_trip(spark, star, tmp_path):
    _, orders, _ = star
    summary = storage.export_table(orders.limit(50), str(tmp_path), "fact_orders")
    assert summary == {"table": "fact_orders", "rows": 50, "columns": len(orders.columns)}
    text = next((tmp_path / "fact_orders.csv").glob("part-*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbforder_id,")
    storage.require_tables(spark, str(tmp_path), {"fact_orders": "export"})
    with pytest.raises(FileNotFoundError, match="dim_x"):
        storage.require_tables(spark, str(tmp_path), {"dim_x": "segments"})
    assert storage.result_report(orders, 3)["rows"] == orders.count()


def test_raw_csv_pipeline(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw.read_raw_csv(spark, str(tmp_path / "nowhere"))
    tables = sample.raw_tables(spark, SF)
    for name in raw.RAW_SCHEMAS:
        tables[name].write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    read = raw.read_raw_csv(spark, str(tmp_path))
    done = facts.run_pipeline(read, sample.SAMPLE_DEFINITIONS, str(tmp_path / "out"))
    assert done["fct_orders"].count() == tables["orders"].count()
    assert done["fct_order_items"].count() == tables["order_items"].count()
    raw.register_views(spark, {"orders": done["orders_clean"]}, {"orders": ["order_id", "is_delivered"]})
    assert spark.sql("SELECT count(*) AS n FROM orders WHERE is_delivered").first().n > 0
    assert spark.table("orders").columns == ["order_id", "is_delivered"]


def test_market_plans_only_what_is_used():
    built = []
    m = Market({"orders": lambda: built.append("orders")})
    assert built == []
    m.orders
    m.orders
    assert built == ["orders"]
    with pytest.raises(ValueError):
        Market({"planets": None})


def test_star_join_keeps_fact_rows(spark, star):
    m, orders, items = star
    joined = exports.star_join({"fact_orders": orders, "dim_date": exports.dim_date(orders, m.defs)}, "fact_orders")
    assert joined.count() == orders.count() and "dim_date__weekday" in joined.columns


@pytest.mark.parametrize("name", ["monthly_revenue_and_growth", "customer_rfm_scores", "quality_orphans", "test_late_vs_score"])
def test_registered_queries_run(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_column_profile_covers_every_raw_table(spark):
    tables = sample.raw_tables(spark, SF)
    got = {(r.table, r.column): (r.non_null, r.n_unique) for r in all_queries()["quality_column_profile"](spark, SF).collect()}
    assert set(got) == {(name, c) for name, df in tables.items() for c in df.columns} and len(tables) == 9
    for name in ("payments", "geolocation", "category_translation"):
        df = tables[name]
        want = df.agg(*[F.struct(F.count(c), F.count_distinct(c)).alias(c) for c in df.columns]).first()
        assert {c: got[name, c] for c in df.columns} == {c: tuple(want[c]) for c in df.columns}
