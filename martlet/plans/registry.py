"""Every report and operator by name, over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.operators import (cleaning, clusters, cohorts, customers, describe, facts, filters, forecasting, hypothesis,
                               metrics, quality, rfm, series, stationarity, views)
from martlet.plans import contexts, exports, measures, pages
from martlet.plans.customer_pack import CUSTOMER_QUERIES, ntile_rfm
from martlet.plans.marketing_pack import MARKETING_QUERIES
from martlet.plans.product_pack import PRODUCT_QUERIES
from martlet.plans.revenue_pack import REVENUE_QUERIES
from martlet.plans.star import fact_order_items, fact_orders, items_with_payment
from martlet.sources import sample
from martlet.sources.market import Market
from martlet.sources.raw import GRAIN

Query = Callable[[SparkSession, str], DataFrame]
Job = Callable[[Market], DataFrame]

NAMED_QUERIES: dict[str, Job] = {**REVENUE_QUERIES, **CUSTOMER_QUERIES, **PRODUCT_QUERIES, **MARKETING_QUERIES}

# Slicer values used by the filtered reports.
SOME_ORDERS = filters.Slice(order_year=(1997, 1998), customer_state=("NATION_1", "NATION_2", "NATION_3"),
                            payment_type=("credit_card", "boleto"), since=date(1997, 3, 1), until=date(1998, 10, 31))
SOME_SELLERS = filters.Slice(order_year=(1997, 1998), payment_type=("credit_card",),
                             seller_state=("NATION_1", "NATION_4", "NATION_7", "NATION_11"))
HIGH_VOLUME = ("Premium + high volume", "Budget + high volume")
SOME_CUSTOMERS = filters.Slice(rfm_segment=("Champions", "Loyal", "At Risk"))
SOME_RISKS = ("3. Lapsed - HIGH value (priority win-back)",)
SOME_CLUSTERS = ("High-value single buyers", "Multi-category buyers")
EVENT_DAY = date(1998, 11, 24)


# Features that the thresholds, and those that the clusters and their profile read. A job names the features it reads beyond
# them, so that nothing else is computed and kept.
SPEND = exports.SPEND
POINTS = ("aov", "n_categories")
PROFILE = (*POINTS, "total_items", "avg_review")
ALL_FEATURES = None


def _features(m: Market) -> DataFrame:
    return customers.customer_features(fact_orders(m), fact_order_items(m, sellers=False), m.defs)


@lru_cache(maxsize=8)
def _people(m: Market, columns: tuple[str, ...] | None = ()) -> DataFrame:
    found = _features(m)
    return (found if columns is None else found.select("customer_unique_id", *dict.fromkeys([*SPEND, *columns]))).persist()


@lru_cache(maxsize=8)
def _segmented(m: Market, columns: tuple[str, ...] | None = ()) -> DataFrame:
    return exports.segmented_customers(fact_orders(m), fact_order_items(m, sellers=False), m.defs, columns)


def _dim(m: Market, columns: tuple[str, ...] | None = ()) -> DataFrame:
    return exports.dim_customers(_segmented(m, columns))


@lru_cache(maxsize=8)
def _dim_clustered(m: Market, columns: tuple[str, ...] | None = PROFILE) -> DataFrame:
    return exports.dim_customers(clusters.with_clusters(_segmented(m, columns)))


@lru_cache(maxsize=4)
def _risky(m: Market) -> DataFrame:
    return customers.with_risk(_people(m), fact_orders(m), m.defs)


@lru_cache(maxsize=8)
def _scored(m: Market, columns: tuple[str, ...] | None = ()) -> DataFrame:
    return rfm.with_rfm_segment(rfm.with_rfm_scores(_people(m, columns)))


def _points(m: Market) -> DataFrame:
    return clusters.points_of(_people(m, POINTS))


def _clustered(m: Market) -> DataFrame:
    return clusters.with_clusters(_scored(m, PROFILE))


def _state_days(m: Market) -> DataFrame:
    return series.daily_series(fact_orders(m), F.col("customer_state"))


def _state_months(m: Market) -> DataFrame:
    return series.monthly_series(fact_orders(m), F.col("customer_state"))


def _month_split(m: Market, test: int = 4) -> DataFrame:
    return series.split_tail(series.regular(_state_months(m)), test)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, for stable comparison of statistics."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


ORDER_REPORTS: dict[str, Callable[[DataFrame, Market], DataFrame]] = {
    "kpis": lambda o, m: metrics.kpis(o),
    "metric_monthly_revenue": lambda o, m: metrics.monthly_revenue(o, m.defs),
    "metric_revenue_by_state": lambda o, m: metrics.revenue_by_state(o),
    "highest_and_lowest_state": lambda o, m: metrics.rank_states(metrics.revenue_by_state(o), "aov"),
    "payment_mix": lambda o, m: metrics.payment_mix(o),
    "instalment_curve": lambda o, m: metrics.instalment_curve(o, m.defs),
    "instalment_bands": lambda o, m: metrics.instalment_bands(o, m.defs),
    "region_scorecard": lambda o, m: metrics.region_scorecard(o, m.defs.min_orders_per_state),
    "region_correlations": lambda o, m: metrics.region_correlations(metrics.region_scorecard(o, m.defs.min_orders_per_state)),
    "basket_bands": lambda o, m: metrics.basket_bands(o),
    "value_drivers": lambda o, m: metrics.value_drivers(o),
    "weekday_table": lambda o, m: metrics.weekday_table(o),
    "busiest_days": lambda o, m: metrics.busiest_days(o),
    "around_event": lambda o, m: metrics.around_event(o, EVENT_DAY),
    "like_for_like_months": lambda o, m: metrics.like_for_like_months(
        o, m.defs.prior_span.months + m.defs.recent_span.months),
    "reviews_by_lateness": lambda o, m: metrics.reviews_by_lateness(o),
    "delivery_by_score": lambda o, m: metrics.delivery_by_score(o),
    "estimate_padding": lambda o, m: metrics.estimate_padding(o),
    "order_value_profile": lambda o, m: describe.describe_money(o, "revenue"),
    "order_value_below_mean": lambda o, m: describe.below_mean_share(o, "revenue"),
    "distribution_shape": lambda o, m: describe.shape(
        o, {"revenue": F.col("revenue"), "freight": F.col("freight"), "items_in_order": F.col("items_in_order")}),
    "payment_value_counts": lambda o, m: describe.value_counts(o, "payment_type"),
    "repurchase_gap_table": lambda o, m: customers.repurchase_gap_table(o),
    "repurchase_gap_distribution": lambda o, m: customers.gap_distribution(o),
    "lapse_threshold": lambda o, m: _rounded(customers.lapse_threshold(o, m.defs), 4),
    "first_experience_by_lateness": lambda o, m: customers.first_experience_by_lateness(o),
    "first_experience_by_score": lambda o, m: customers.first_experience_by_score(o),
    "retention_matrix": lambda o, m: cohorts.retention_matrix(o),
    "retention_pivot": lambda o, m: cohorts.retention_pivot(o, m.defs.last_age),
    "retention_curve": lambda o, m: cohorts.retention_curve(o),
    "retention_curve_zero_filled": lambda o, m: cohorts.retention_curve(o, True, m.defs.last_month_index),
    "cohort_summary": lambda o, m: cohorts.cohort_summary(o, m.defs.last_month_index),
    "cohort_fair_comparison": lambda o, m: cohorts.fair_comparison(o, m.defs.last_month_index),
    "cohort_fair_trend": lambda o, m: cohorts.fair_trend(o, m.defs.last_month_index),
    "cohort_censoring": lambda o, m: cohorts.censoring(o, m.defs.last_month_index),
    "cohort_revenue_retention": lambda o, m: cohorts.revenue_retention(o),
    "cohort_later_revenue": lambda o, m: cohorts.later_revenue_share(o),
    "test_welch_payment_value": lambda o, m: _rounded(hypothesis.welch(
        o, F.col("revenue"), F.col("payment_type"), *m.defs.compared_payments), 4),
    "test_welch_by_state": lambda o, m: _rounded(hypothesis.welch(
        o, F.col("revenue"), F.col("payment_type"), *m.defs.compared_payments, strata=["customer_state"]), 2),
    "test_welch_single_item": lambda o, m: _rounded(hypothesis.welch(
        o.where(F.col("items_in_order") == 1), F.col("revenue"), F.col("payment_type"), *m.defs.compared_payments), 4),
    "test_welch_log": lambda o, m: _rounded(hypothesis.welch_log(
        o, F.col("revenue"), F.col("payment_type"), *m.defs.compared_payments), 5),
    "test_mann_whitney": lambda o, m: _rounded(hypothesis.mann_whitney(
        o.select("payment_type", (F.col("revenue") * 100).cast("bigint").alias("cents")), "cents", "payment_type",
        *m.defs.compared_payments), 6),
    "test_mann_whitney_by_state": lambda o, m: _rounded(hypothesis.mann_whitney(
        o.select("customer_state", "payment_type", (F.col("revenue") * 100).cast("bigint").alias("cents")), "cents",
        "payment_type", *m.defs.compared_payments, strata=["customer_state"]), 6),
    "test_late_vs_one_star": lambda o, m: _rounded(hypothesis.risk_difference(
        o, F.col("is_late"), F.col("review_score") == 1), 6),
    "test_late_vs_one_star_by_state": lambda o, m: _rounded(hypothesis.risk_difference(
        o, F.col("is_late"), F.col("review_score") == 1, strata=["customer_state"]), 6),
    "test_late_vs_score": lambda o, m: _rounded(hypothesis.chi_square(o, "is_late", "review_score"), 6),
    "test_late_first_vs_repeat": lambda o, m: _rounded(hypothesis.two_proportions(
        customers.first_orders(o), F.col("is_late"), F.col("came_back")), 6),
    "test_detectable_effect": lambda o, m: _rounded(hypothesis.detectable_effect(hypothesis.welch(
        o, F.col("revenue"), F.col("payment_type"), *m.defs.compared_payments)), 4),
    "export_dim_date": lambda o, m: exports.dim_date(o, m.defs),
    "export_revenue_forecast": lambda o, m: exports.fact_revenue_forecast(o),
    "export_forecast_models": lambda o, m: exports.dim_forecast_models(o),
    "measures_orders": lambda o, m: _rounded(measures.page_dataset(o, [], measures.order_measures(m.defs))),
    "measures_orders_by_month": lambda o, m: _rounded(measures.page_dataset(o, ["order_month"], measures.order_measures(m.defs))),
    "measure_median_by_state": lambda o, m: _rounded(measures.median_order_value(o, ["customer_state"])),
    "measure_revenue_mom": lambda o, m: _rounded(measures.revenue_mom(o)),
    "measures_retention": lambda o, m: _rounded(measures.page_dataset(
        exports.fact_cohort_retention(o), ["months_since_first_purchase"], measures.retention_measures()), 12),
    "measures_cohort": lambda o, m: _rounded(measures.page_dataset(
        exports.dim_cohort_summary(o, m.defs), ["cohort_month"], measures.cohort_measures())),
    "measures_forecast": lambda o, m: measures.page_dataset(
        exports.fact_revenue_forecast(o), ["period_label"], measures.forecast_measures()),
    "measure_next_month": lambda o, m: measures.next_month(exports.fact_revenue_forecast(o)),
    "page_card_value_by_instalment": lambda o, m: _rounded(measures.page_dataset(
        o, ["max_installments"], {"AOV (Credit Card)": measures.order_measures(m.defs)["AOV (Credit Card)"]},
        SOME_ORDERS.predicate())),
}

ITEM_REPORTS: dict[str, Callable[[DataFrame, Market], DataFrame]] = {
    "metric_revenue_by_category": lambda i, m: metrics.revenue_by_category(i),
    "product_pareto": lambda i, m: metrics.product_pareto(i),
    "product_pareto_curve": lambda i, m: metrics.pareto_curve(i),
    "product_summary": lambda i, m: metrics.product_summary(i),
    "category_table": lambda i, m: metrics.category_table(
        i, m.defs, metrics.price_volume_quadrants(i, m.defs.min_units_per_category)),
    "momentum_extremes": lambda i, m: metrics.momentum_extremes(metrics.category_table(i, m.defs), m.defs),
    "metric_top_products": lambda i, m: metrics.top_products(i),
    "price_volume_quadrants": lambda i, m: _rounded(metrics.price_volume_quadrants(i, m.defs.min_units_per_category), 4),
    "quadrant_profile": lambda i, m: metrics.quadrant_profile(metrics.price_volume_quadrants(i, m.defs.min_units_per_category)),
    "momentum_summary": lambda i, m: metrics.momentum_summary(i, m.defs),
    "category_freight_burden": lambda i, m: metrics.freight_burden(i, m.defs.min_freight_units),
    "premium_routes": lambda i, m: metrics.premium_routes(i),
    "regional_mix": lambda i, m: metrics.regional_mix(i, "NATION_1"),
    "seller_revenue_concentration": lambda i, m: customers.concentration(
        i.groupBy("seller_id").agg(F.sum("revenue").alias("revenue")), "revenue"),
    "measures_items_by_category": lambda i, m: _rounded(measures.page_dataset(i, ["category"], measures.item_measures())),
    "measures_category": lambda i, m: _rounded(measures.page_dataset(
        exports.dim_category(i, m.defs), ["category"], measures.category_measures()), 2),
}

STAR_REPORTS: dict[str, Callable[[DataFrame, DataFrame, Market], DataFrame]] = {
    "seller_scorecard": lambda o, i, m: metrics.seller_scorecard(i, o, min_orders=5),
    "late_sellers": lambda o, i, m: metrics.late_sellers(i, o, min_orders=20),
    "top_category_per_state": lambda o, i, m: metrics.top_category_per_state(i, m.defs.min_orders_per_state, o),
    "export_dim_seller": lambda o, i, m: exports.dim_seller(i, o),
    "filtered_kpis": lambda o, i, m: metrics.kpis(SOME_ORDERS.of(o)),
    "filtered_product_summary": lambda o, i, m: metrics.product_summary(filters.in_quadrants(
        SOME_SELLERS.of(items_with_payment(i, o)), metrics.price_volume_quadrants(i, m.defs.min_units_per_category), HIGH_VOLUME)),
    "filter_domains": lambda o, i, m: (
        filters.filter_domain(o, "order_year").unionByName(filters.filter_domain(o, "customer_state"))
        .unionByName(filters.filter_domain(o, "payment_type")).unionByName(filters.filter_domain(i, "category"))
        .unionByName(filters.filter_domain(i, "seller_state"))),
    "filter_requested_values": lambda o, i, m: (
        filters.requested_values(o, "customer_state", ("NATION_1", "NATION_24", "nation_1", "ATLANTIS"))
        .unionByName(filters.requested_values(o, "order_year", (1997, 1850)))
        .unionByName(filters.requested_values(i, "seller_state", ("NATION_3", "")))),
    "filter_date_domain": lambda o, i, m: filters.date_domain(o),
    "star_revenue_by_calendar": lambda o, i, m: _rounded(exports.star_join(
        {"fact_orders": o, "dim_date": exports.dim_date(o, m.defs)}, "fact_orders").groupBy(
        F.col("dim_date__year").alias("year"), F.col("dim_date__is_weekend").alias("is_weekend")).agg(
        *[c.alias(n) for n, c in measures.order_measures(m.defs).items() if n in ("Total Revenue", "Orders", "AOV (Mean)")])),
    "star_relationship_check": lambda o, i, m: exports.check_relationships({
        "fact_orders": o, "fact_order_items": i, "dim_date": exports.dim_date(o, m.defs), "dim_customers_segmented": _dim(m),
        "dim_region_performance": metrics.region_scorecard(o), "dim_payment_performance": metrics.payment_mix(o),
        "dim_product_performance": exports.dim_product(i), "dim_category_performance": exports.dim_category(i, m.defs),
        "dim_seller_performance": exports.dim_seller(i, o), "fact_cohort_retention": exports.fact_cohort_retention(o),
        "dim_cohort_summary": exports.dim_cohort_summary(o, m.defs)}),
}

MARKET_REPORTS: dict[str, Job] = {
    "ntile_rfm_all_customers": ntile_rfm,
    "view_analysis_orders": views.analysis_orders,
    "view_analysis_items": views.analysis_items,
    "fct_order_items": lambda m: facts.order_items_fact(m).drop("order_purchase_timestamp", "shipping_limit_date"),
    "fct_orders": lambda m: facts.orders_fact(m).select(
        "order_id", "customer_unique_id", "order_month", "order_status", "is_delivered", "in_window", "order_revenue",
        "order_freight", "n_items", "n_distinct_products", "n_sellers", "max_item_price", "payment_total",
        "n_payment_records", "max_installments", "payment_type", "review_score", "has_comment", "response_days",
        "has_items", "is_multi_item", "avg_item_price", "customer_state"),
    "export_fact_orders": fact_orders,
    "export_fact_order_items": fact_order_items,
    "export_dim_category": lambda m: exports.dim_category(fact_order_items(m, sellers=False), m.defs),
    "export_dim_product": lambda m: exports.dim_product(fact_order_items(m, sellers=False)),
    "customer_features": lambda m: _rounded(_features(m), 4),
    "customer_risk_tiers": lambda m: customers.risk_profile(_risky(m)),
    "customer_lapse_status": lambda m: customers.lapse_status(_risky(m)),
    "customer_value_deciles": lambda m: customers.value_decile_table(customers.with_value_decile(_people(m))),
    "customer_concentration": lambda m: customers.concentration(_features(m), "monetary"),
    "customer_geography": lambda m: customers.geography_profile(_people(m, ALL_FEATURES)),
    "customer_frequency_table": lambda m: customers.frequency_table(_features(m)),
    "customer_repeat_comparison": lambda m: customers.repeat_comparison(_features(m)),
    "rfm_scores": lambda m: _scored(m).select(
        "customer_unique_id", "recency", "frequency", F.col("monetary").cast("double").alias("monetary"), "r_score", "f_score",
        "m_score", "rfm_cell", "rfm_sum", "rfm_segment"),
    "rfm_segment_profile": lambda m: rfm.segment_profile(_scored(m, ("aov", "avg_review"))),
    "rfm_score_bands": lambda m: rfm.score_bands(_scored(m), "r_score", "recency"),
    "rfm_score_grid": lambda m: rfm.score_grid(_scored(m)),
    "rfm_frequency_crosstab": lambda m: rfm.crosstab(_scored(m), "rfm_segment", "f_score"),
    "agreement_segment_decile": lambda m: rfm.agreement(
        customers.with_value_decile(_scored(m)), "rfm_segment", "value_decile"),
    "cluster_feature_matrix": lambda m: _rounded(clusters.standardise(clusters.feature_matrix(_people(m, POINTS))), 5),
    "cluster_k_scan": lambda m: clusters.scan_k(_points(m), range(2, 9)),
    "cluster_decomposition": lambda m: clusters.decomposition(_points(m), range(2, 9)),
    "cluster_profile": lambda m: clusters.name_clusters(clusters.cluster_profile(_clustered(m))),
    "cluster_segment_crosstab": lambda m: rfm.crosstab(_clustered(m), "rfm_segment", "cluster_name"),
    "cluster_agreement": lambda m: rfm.agreement(_clustered(m), "rfm_segment", "cluster"),
    "export_dim_customers": lambda m: _dim(m, ALL_FEATURES),
    "export_dim_customers_clustered": lambda m: _dim_clustered(m, ALL_FEATURES),
    "customer_segments_by_cluster": lambda m: metrics.customer_segments(_dim_clustered(m), "kmeans_segment"),
    "filtered_customers_by_cluster": lambda m: metrics.customers_summary(filters.Slice(kmeans_segment=SOME_CLUSTERS).of(_dim_clustered(m))),
    "customers_summary": lambda m: metrics.customers_summary(_dim(m)),
    "customer_segments": lambda m: metrics.customer_segments(_dim(m)),
    "filtered_customers_summary": lambda m: metrics.customers_summary(SOME_CUSTOMERS.of(_dim(m))),
    "filtered_customers_by_state": lambda m: metrics.customers_summary(
        filters.Slice(customer_state=("NATION_2", "NATION_5")).of(_dim(m, ("state",)))),
    "filtered_customers_by_risk": lambda m: metrics.customers_summary(filters.Slice(risk_tier=SOME_RISKS).of(_dim(m))),
    "metric_top_customers": lambda m: metrics.top_customers(_dim(m, ("state", "n_categories"))),
    "filtered_retention_curve": lambda m: cohorts.retention_curve(metrics.orders_of(
        fact_orders(m), SOME_CUSTOMERS.of(_dim(m)))),
    "filtered_cohort_summary": lambda m: cohorts.cohort_summary(metrics.orders_of(
        fact_orders(m), SOME_CUSTOMERS.of(_dim(m))), m.defs.last_month_index),
    "measures_customers": lambda m: _rounded(measures.page_dataset(_dim(m), ["risk_tier"], measures.customer_measures())),
    "measure_segment_revenue_share": lambda m: _rounded(measures.segment_revenue_share(
        _dim(m), "rfm_segment", F.col("risk_tier").startswith("3"))),
    "quality_time_violations": lambda m: quality.time_violations(m.orders),
    "quality_status_consistency": lambda m: quality.status_consistency(m.orders),
    "quality_delivery_clusters": lambda m: quality.delivery_clusters(m.orders),
    "quality_reconciliation": lambda m: quality.reconciliation(m.items, m.payments),
    "quality_iqr_outliers": lambda m: quality.iqr_outliers(m.items),
    "quality_value_sanity": lambda m: quality.value_sanity(m.items, {
        "price <= 0": F.col("price") <= 0, "freight_value < 0": F.col("freight_value") < 0,
        "freight_value = 0": F.col("freight_value") == 0}),
    "series_daily": lambda m: _state_days(m),
    "series_monthly": lambda m: _state_months(m),
    "series_tail_report": lambda m: series.trim_report(_state_days(m)),
    "series_trimmed": lambda m: series.trim_truncated_tail(_state_days(m)),
    "series_rolling_mean": lambda m: series.rolling_mean(_state_days(m)),
    "series_weekday_index": lambda m: series.weekday_index(_state_days(m)),
    "series_autocorrelation": lambda m: _rounded(series.autocorrelation(series.differences(_state_days(m)), 30)),
    "series_seasonality": lambda m: series.seasonality(_state_days(m)),
    "series_dickey_fuller": lambda m: series.dickey_fuller(series.regular(_state_months(m))),
    "series_kpss": lambda m: series.kpss(series.regular(_state_months(m))),
    "series_adf_by_criterion": lambda m: stationarity.augmented_dickey_fuller(_state_months(m)),
    "series_adf_one_lag": lambda m: stationarity.augmented_dickey_fuller(_state_months(m), 1),
    "series_adf_two_lags": lambda m: stationarity.augmented_dickey_fuller(_state_months(m), 2),
    "series_diagnosis": lambda m: stationarity.diagnosis(_state_days(m)),
    "forecast_baselines": lambda m: _rounded(forecasting.baselines(_month_split(m).where(~F.col("is_test")), 4), 4),
    "forecast_seasonal_naive": lambda m: _rounded(forecasting.seasonal_naive(
        series.split_tail(_state_days(m), 28).where(~F.col("is_test")), 28, 7), 4),
    "forecast_smoothing": lambda m: _rounded(forecasting.simple_smoothing(_month_split(m).where(~F.col("is_test")), 4), 2),
    "forecast_arima_011": lambda m: _rounded(forecasting.arima_011(_month_split(m).where(~F.col("is_test")), 3), 2),
    "forecast_arima_110": lambda m: _rounded(forecasting.arima_110(_month_split(m).where(~F.col("is_test")), 4), 2),
    "forecast_ladder_closed_form": lambda m: forecasting.evaluate(_month_split(m), 4, holt=False),
    "forecast_ladder": lambda m: forecasting.evaluate(_month_split(m), 4),
    "forecast_ladder_daily": lambda m: forecasting.evaluate(series.split_tail(series.regular(series.daily_series(fact_orders(m), F.lit("all"))), 28), 28, 7),
    "forecast_holt_family": lambda m: _rounded(forecasting.holt_family(_month_split(m).where(~F.col("is_test")), 4, 12), 2),
    "forecast_history_and_future": lambda m: forecasting.history_and_forecast(_state_months(m)),
}


def _page(name: str, dataset: str | None, *wanted: str, sliced: Callable[[], Column] | None = None, only: tuple[str, ...] | None = None) -> Job:
    """One page dataset, or the charts of a page (all or ``only`` some), over the export tables it reads."""
    def job(m: Market) -> DataFrame:
        makers = {"fact_orders": lambda: fact_orders(m), "fact_order_items": lambda: fact_order_items(m, sellers=False),
                  "dim_customers_segmented": lambda: _dim(m),
                  "dim_category_performance": lambda: exports.dim_category(fact_order_items(m, sellers=False), m.defs),
                  "dim_product_performance": lambda: exports.dim_product(fact_order_items(m, sellers=False)),
                  "dim_region_performance": lambda: metrics.region_scorecard(fact_orders(m)),
                  "dim_seller_performance": lambda: exports.dim_seller(fact_order_items(m), fact_orders(m)),
                  "fact_cohort_retention": lambda: exports.fact_cohort_retention(fact_orders(m)),
                  "dim_cohort_summary": lambda: exports.dim_cohort_summary(fact_orders(m), m.defs),
                  "fact_revenue_forecast": lambda: exports.fact_revenue_forecast(fact_orders(m)),
                  "dim_forecast_model_comparison": lambda: exports.dim_forecast_models(fact_orders(m))}
        tables = {t: makers[t]() for t in wanted} | ({"dim_customers_segmented": _dim_clustered(m)} if dataset == "revenue_by_cluster" else {})
        if dataset is None:
            return _rounded(pages.page_rows(name, tables, m.defs, {"fact_orders": sliced()} if sliced else None, only), 4)
        return _rounded(pages.PAGES[name][dataset](tables, sliced() if sliced else None, m.defs), 4)
    return job


def _slice() -> Column:
    return SOME_ORDERS.predicate()


MARKET_REPORTS |= {
    "page_overview_cards": _page("overview", "cards", "fact_orders", sliced=_slice),
    "page_overview_median": _page("overview", "median_card", "fact_orders", sliced=_slice),
    "page_overview_trend": _page("overview", "monthly_trend", "fact_orders", sliced=_slice),
    "page_overview_states": _page("overview", "revenue_by_state", "fact_orders"),
    "page_customers_segments": _page("customers", "revenue_by_rfm", "dim_customers_segmented"),
    "page_products_price_and_volume": _page("products", "price_and_volume", "dim_category_performance", "fact_order_items"),
    "page_products_best": _page("products", "best_products", "dim_product_performance"),
    "page_marketing_payments": _page("marketing", "revenue_by_payment", "fact_orders", sliced=_slice),
    "page_overview": _page("overview", None, "fact_orders", "fact_order_items", sliced=_slice),
    "page_customers": _page("customers", None, "dim_customers_segmented", "fact_cohort_retention", "dim_cohort_summary",
                            only=("cards", "revenue_by_rfm", "retention", "fair_cohorts")),
    "page_customers_clusters": _page("customers", "revenue_by_cluster"),
    "page_products": _page("products", None, "fact_order_items", "dim_category_performance"),
    "page_marketing": _page("marketing", None, "fact_orders", sliced=_slice),
    "page_marketing_states": _page("marketing", "states", "dim_region_performance"),
    "page_marketing_sellers": _page("marketing", "sellers", "dim_seller_performance"),
    "page_forecast": _page("forecast", None, "fact_revenue_forecast"),
    "page_forecast_cards": _page("forecast", "cards", "fact_revenue_forecast"),
    "page_forecast_models": _page("forecast", "models", "dim_forecast_model_comparison"),
}


def _context(table: str, make: Callable[[Market], DataFrame], *axes: tuple[str, ...], slicers: Callable[[], dict[str, Column]] = dict, digits: int = 6) -> Job:
    """All measures of a table under several axes."""
    return lambda m: _rounded(contexts.evaluate(make(m), axes, contexts.measures_of(m.defs)[table], slicers()), digits)


MARKET_REPORTS |= {
    "context_orders": _context("fact_orders", fact_orders, ("order_month",), ("customer_state",), ("payment_type",), ()),
    "context_orders_sliced": _context("fact_orders", fact_orders, ("order_month",), ("customer_state",), (), slicers=lambda: {
        "order_month": F.col("order_month").between("1997-03", "1998-10"), "payment_type": F.col("payment_type").isin("credit_card", "boleto")}),
    "context_order_medians": lambda m: _rounded(contexts.medians(fact_orders(m), ("order_month", "customer_state", "payment_type"), "revenue", "AOV (Median)")),
    "context_items": _context("fact_order_items", fact_order_items, ("category",), ("seller_state",), ("customer_state",)),
    "context_customers": _context("dim_customers_segmented", lambda m: _dim(m, ("state",)), ("rfm_segment",), ("risk_tier",), ("customer_state",), ("rfm_segment", "risk_tier")),
    "context_customers_sliced": _context("dim_customers_segmented", _dim, ("rfm_segment",), ("risk_tier",), (), slicers=lambda: {
        "risk_tier": F.col("risk_tier").startswith("3")}),
    "context_retention": _context("fact_cohort_retention", lambda m: exports.fact_cohort_retention(fact_orders(m)),
                                  ("months_since_first_purchase",), ("cohort_month",), (), digits=12),
    "context_cohorts": _context("dim_cohort_summary", lambda m: exports.dim_cohort_summary(fact_orders(m), m.defs), ("cohort_month",), ()),
    "context_categories": _context("dim_category_performance", lambda m: exports.dim_category(fact_order_items(m, sellers=False), m.defs), ("category",), ()),
    "context_forecast": _context("fact_revenue_forecast", lambda m: exports.fact_revenue_forecast(fact_orders(m)), ("period_label",), ("type",), ()),
}


def _raw_checks(t: dict[str, DataFrame]) -> DataFrame:
    return quality.orphans({
        "orders.customer_id -> customers": (t["orders"], "customer_id", t["customers"], "customer_id"),
        "order_items.order_id -> orders": (t["order_items"], "order_id", t["orders"], "order_id"),
        "order_items.product_id -> products": (t["order_items"], "product_id", t["products"], "product_id"),
        "order_items.seller_id -> sellers": (t["order_items"], "seller_id", t["sellers"], "seller_id"),
        "payments.order_id -> orders": (t["payments"], "order_id", t["orders"], "order_id"),
        "reviews.order_id -> orders": (t["reviews"], "order_id", t["orders"], "order_id"),
        "products.category -> translation": (t["products"], "product_category_name", t["category_translation"],
                                             "product_category_name")})


def _validation(t: dict[str, DataFrame]) -> DataFrame:
    m = facts.clean_market(t, sample.SAMPLE_DEFINITIONS)
    return quality.validation_checks(t, m.orders, m.items, m.customers, m.reviews, facts.order_items_fact(m),
                                     facts.orders_fact(m), m.geolocation)


RAW_REPORTS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "clean_orders": lambda t: cleaning.clean_orders(t["orders"], sample.SAMPLE_DEFINITIONS),
    "clean_order_items": lambda t: cleaning.clean_items(t["order_items"], sample.SAMPLE_DEFINITIONS),
    "clean_customers": lambda t: cleaning.clean_customers(t["customers"]),
    "clean_sellers": lambda t: cleaning.clean_sellers(t["sellers"]),
    "clean_products": lambda t: cleaning.clean_products(t["products"], t["category_translation"], sample.SAMPLE_DEFINITIONS),
    "clean_payments": lambda t: cleaning.clean_payments(t["payments"], sample.SAMPLE_DEFINITIONS),
    "clean_reviews": lambda t: cleaning.clean_reviews(t["reviews"]),
    "clean_geolocation": lambda t: cleaning.clean_geolocation(t["geolocation"], sample.SAMPLE_DEFINITIONS),
    "quality_inventory": quality.inventory,
    "quality_column_profile": quality.column_profile,
    "quality_missing_values": quality.missing_values,
    "quality_duplicates": lambda t: quality.duplicates(t, GRAIN),
    "quality_review_conflicts": lambda t: quality.key_conflicts(t["reviews"], "order_id", "review_score"),
    "quality_date_coverage": lambda t: quality.date_coverage(t, {
        "orders": cleaning.ORDER_TIMES, "order_items": ["shipping_limit_date"],
        "reviews": ["review_creation_date", "review_answer_timestamp"]}),
    "quality_orphans": _raw_checks,
    "quality_childless_parents": lambda t: quality.childless_parents(t["orders"], "order_id", "order_status", {
        "order_items": t["order_items"], "payments": t["payments"], "reviews": t["reviews"]}),
    "quality_translation_coverage": lambda t: quality.translation_coverage(
        t["products"], t["category_translation"], t["order_items"]),
    "quality_unused_translations": lambda t: quality.unused_translations(t["products"], t["category_translation"]),
    "quality_zip_coverage": lambda t: quality.zip_coverage(t["sellers"], "seller_zip_code_prefix", t["geolocation"]),
    "quality_coordinates": lambda t: quality.coordinates(t["geolocation"]),
    "quality_score_shift": lambda t: quality.distribution_shift(
        t["reviews"], cleaning.clean_reviews(t["reviews"]), "review_score"),
    "quality_validation_checks": _validation,
}


def over_market(job: Job) -> Query:
    return lambda spark, sf_dir: job(sample.sample_market(spark, sf_dir))


def over_orders(job: Callable[[DataFrame, Market], DataFrame]) -> Query:
    return over_market(lambda m: job(fact_orders(m), m))


def over_items(job: Callable[[DataFrame, Market], DataFrame]) -> Query:
    return over_market(lambda m: job(fact_order_items(m), m))


def over_star(job: Callable[[DataFrame, DataFrame, Market], DataFrame]) -> Query:
    return over_market(lambda m: job(fact_orders(m), fact_order_items(m), m))


def over_raw(job: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(sample.raw_tables(spark, sf_dir))


def over_events(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(sample.table(spark, sf_dir, "events"))


def all_queries() -> dict[str, Query]:
    found = {name: over_market(job) for name, job in {**NAMED_QUERIES, **MARKET_REPORTS}.items()}
    found |= {name: over_orders(job) for name, job in ORDER_REPORTS.items()}
    found |= {name: over_items(job) for name, job in ITEM_REPORTS.items()}
    found |= {name: over_star(job) for name, job in STAR_REPORTS.items()}
    found |= {name: over_raw(job) for name, job in RAW_REPORTS.items()}
    found["weekday_hour_counts"] = over_events(lambda e: metrics.weekday_hour_counts(e, "ts"))
    found["weekday_hour_pivot"] = over_events(lambda e: metrics.weekday_hour_pivot(e, "ts"))
    return found
