"""Jobs read the tables and features that they need, and no others."""

from martlet.operators import customers
from martlet.plans import exports
from martlet.plans.star import fact_order_items, fact_orders
from martlet.sources.sample import sample_market

SF = "/root/testdata/sf0.001"


def tables(df):
    return {f.rsplit("/", 1)[1].removesuffix(".parquet") for f in df.inputFiles()}


def test_lines_without_sellers_are_the_same_lines(spark):
    m = sample_market(spark, SF)
    whole, lean = fact_order_items(m), fact_order_items(m, sellers=False)
    assert "supplier" in tables(whole) and "supplier" not in tables(lean)
    assert set(whole.columns) - set(lean.columns) == {"seller_state", "same_state_delivery"}
    assert sorted(map(str, whole.select(lean.columns).collect())) == sorted(map(str, lean.collect()))


def test_kept_features_are_those_a_job_reads(spark):
    m = sample_market(spark, SF)
    some = exports.segmented_customers(fact_orders(m), fact_order_items(m, sellers=False), m.defs, columns=("state",))
    assert "state" in some.columns and not {"n_categories", "avg_review", "n_sellers"} & set(some.columns)
    whole = exports.dim_customers(exports.segmented_customers(fact_orders(m), fact_order_items(m), m.defs))
    lean = exports.dim_customers(some)
    assert set(lean.columns) < set(whole.columns)
    assert sorted(map(str, whole.select(lean.columns).collect())) == sorted(map(str, lean.collect()))
    assert customers.customer_features(fact_orders(m), fact_order_items(m)).columns[0] == "customer_unique_id"
