"""Tests and forecasts against brute force and textbook values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlet.functions import tails
from martlet.operators import clusters, forecasting, holt, hypothesis, kmeans, rfm, series


def test_tail_functions():
    # published table values
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert tails.t_two_sided(2.085963, 20) == pytest.approx(0.05, abs=1e-6)
    assert tails.gamma_upper(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.gamma_upper(2.0, 9.487729 / 2) == pytest.approx(0.05, abs=1e-6)
    assert tails.gamma_upper(0.5, 40.0) == pytest.approx(math.erfc(math.sqrt(40.0)), rel=1e-9)


@pytest.fixture(scope="module")
def two_groups():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 60, 80), rng.integers(10, 90, 45)
    return pd.DataFrame({"g": ["a"] * 80 + ["b"] * 45 + ["c"] * 5, "v": np.concatenate([a, b, [1] * 5])})


def test_welch_and_guard(spark, two_groups):
    df = spark.createDataFrame(two_groups)
    row = hypothesis.welch(df, F.col("v"), F.col("g"), "a", "b").first()
    a, b = (two_groups[two_groups.g == k].v for k in "ab")
    se = math.sqrt(a.var() / 80 + b.var() / 45)
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / se) and row["difference"] == pytest.approx(a.mean() - b.mean())
    assert row["ci_low"] < row["difference"] < row["ci_high"] and not row["insufficient_data"]
    small = hypothesis.welch(df, F.col("v"), F.col("g"), "a", "c").first()
    assert small["insufficient_data"] and small["p_value"] is None and small["decision"] is None and small["n2"] == 5


def test_mann_whitney_with_ties(spark, two_groups):
    row = hypothesis.mann_whitney(spark.createDataFrame(two_groups), "v", "g", "a", "b").first()
    a, b = (two_groups[two_groups.g == k].v.to_numpy() for k in "ab")
    wins = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert row["u"] == pytest.approx(wins) and row["rank_biserial"] == pytest.approx(1 - 2 * wins / (80 * 45))
    joint = np.concatenate([a, b])
    ties = sum(c ** 3 - c for c in np.unique(joint, return_counts=True)[1])
    n = len(joint)
    sd = math.sqrt(80 * 45 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(wins, 80 * 45 - wins) - 80 * 45 / 2 - 0.5) / sd
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


@pytest.mark.parametrize("table", [[[30, 10], [12, 25]], [[30, 10], [0, 25]], [[30, 0], [0, 25]]])
def test_chi_square_with_correction_and_empty_cells(spark, table):
    rows = [(i, j) for i in range(2) for j in range(2) for _ in range(table[i][j])]
    row = hypothesis.chi_square(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    t = np.array(table, dtype=float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    gap = np.abs(t - e)
    assert row["chi2"] == pytest.approx((((gap - np.minimum(gap, 0.5)) ** 2) / e).sum()) and row["dof"] == 1


def test_zero_cell_is_insufficient(spark):
    df = spark.createDataFrame([(True, False)] * 40 + [(False, False)] * 30 + [(False, True)] * 10, "late boolean, one boolean")
    row = hypothesis.risk_difference(df, F.col("late"), F.col("one")).first()
    assert row["insufficient_data"] and row["chi2"] is None and row["rate_other"] == 0.25
    assert hypothesis.two_proportions(df, F.col("late"), F.col("one")).first()["z"] is not None


def _months(spark, values, name="s"):
    periods = pd.date_range("2020-01-01", periods=len(values), freq="MS").date
    return spark.createDataFrame(pd.DataFrame({"series_id": name, "period": periods, "value": np.asarray(values, dtype=float)}))


def test_smoothing_matches_direct_search(spark):
    y = np.array([10, 12, 11, 15, 14, 18, 17, 21, 19, 24.0])
    best = forecasting.best_smoothing(_months(spark, y), 1, 100, 100).first()

    def sse(alpha, start):
        level, out = start, 0.0
        for v in y:
            out += (v - level) ** 2
            level += alpha * (v - level)
        return out

    brute = min((min(sse(k / 100, s) for s in np.linspace(5, 20, 301)), k / 100) for k in range(1, 101))
    assert best["alpha"] == pytest.approx(brute[1], abs=0.02) and best["sse"] <= brute[0] + 1e-9


def _ahead(forecasts):
    return [r["forecast"] for r in sorted(forecasts.collect(), key=lambda r: r["step"])]


def test_holt_follows_a_line_and_seasons(spark):
    line = 5 + 3 * np.arange(24.0)
    assert _ahead(holt.holt_forecast(_months(spark, line), 4, "m", False)) == pytest.approx(5 + 3 * np.arange(24, 28), rel=1e-6)
    wave = np.tile([1.0, 5.0, 2.0, 8.0], 8) + 20
    assert _ahead(holt.holt_forecast(_months(spark, wave), 6, "m", True, 4)) == pytest.approx([*wave[:4], *wave[:2]], rel=1e-6)


def test_holt_finds_the_least_error_of_its_grid(spark):
    y = np.array([10, 14, 11, 19, 16, 24, 20, 29, 22, 31, 30.0, 28])

    def run(alpha, beta, phi, level, trend):
        total = 0.0
        for v in y:
            e = v - level - phi * trend
            level, trend, total = level + phi * trend + alpha * e, phi * trend + alpha * beta * e, total + e * e
        return total, level, trend

    def least(alpha, beta, phi):
        # The errors are linear in the start, so two unit starts and the zero start give the normal equations.
        def errors(level, trend):
            out = []
            for v in y:
                out.append(v - level - phi * trend)
                level, trend = level + phi * trend + alpha * out[-1], phi * trend + alpha * beta * out[-1]
            return np.array(out)

        zero = errors(0, 0)
        start = np.linalg.lstsq(np.stack([zero - errors(1, 0), zero - errors(0, 1)], axis=1), zero, rcond=None)[0]
        return run(alpha, beta, phi, *start)

    for damped, phis in ((False, (1.0,)), (True, holt.PHIS)):
        best = holt.best_holt(_months(spark, y), damped).first()["best"]
        want = min((least(a, b, p) for a in holt.ALPHAS for b in holt.BETAS for p in phis), key=lambda x: x[0])
        assert (best["sse"], best["level"], best["trend"]) == pytest.approx(want, rel=1e-6)


def test_short_series_keep_rows_without_forecast(spark):
    short = _months(spark, [3.0, 4.0, 6.0], "short").unionByName(_months(spark, np.arange(12.0) ** 1.5, "long"))
    got = forecasting.forecasts_for(short, 2, 4).groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("n"), F.count("forecast").alias("known")).collect()
    known = {(r["series_id"], r["model"]): r["known"] for r in got if r["n"] == 2}
    assert {m for s, m in known if s == "short"} >= {holt.HOLT, holt.HOLT_DAMPED, holt.HOLT_WINTERS}
    assert all(known["short", m] == 0 and known["long", m] == 2 for m in (holt.HOLT, holt.HOLT_DAMPED, holt.HOLT_WINTERS))
    ranks = forecasting.score(forecasting.holt_family(short, 2).unionByName(forecasting.baselines(short, 2)), _months(spark, [1.0, 2.0], "short").withColumn("step", F.month("period").cast("bigint"))).collect()
    assert {r["rank"] for r in ranks if r["MAE"] is None} == {5, 6} and len(ranks) == 6


def test_ladder_ranks_every_model_and_handles_short_series(spark):
    both = _months(spark, 5 + 3 * np.arange(20.0), "long").unionByName(_months(spark, [1, 2, 3, 4, 5, 6.0], "short"))
    got = forecasting.evaluate(series.split_tail(both, 4), 4).toPandas()
    long = got[got.series_id == "long"].set_index("model")
    assert set(long.index) == {"Naive (last value)", "Mean (all history)", "Moving average (3)", "Drift", "Simple exp smoothing",
                               "ARIMA(0, 1, 1)", "ARIMA(1, 1, 0)", "Holt (additive trend)", "Holt (damped trend)"}
    assert long.loc["Drift", "MAE"] == pytest.approx(0, abs=1e-6) and long.loc["Naive (last value)", "vs_naive_pct"] == 0
    assert "Drift" in set(got[got.series_id == "short"].model)


def test_mape_is_missing_with_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, f double")
    row = df.agg(*[c.alias(n) for n, c in forecasting.error_metrics(F.col("a"), F.col("f")).items()]).first()
    assert row["MAPE_pct"] is None and row["MAE"] == 1.0


def test_daily_spine_and_tail_trim(spark):
    days = pd.date_range("2020-01-01", periods=60)
    rows = [(d.to_pydatetime(), 10.0) for d in days[:57] for _ in range(4) if d.day != 5] + [(days[59].to_pydatetime(), 10.0)]
    orders = spark.createDataFrame(rows, "order_timestamp timestamp_ntz, revenue double")
    daily = series.daily_series(orders, F.lit("all"))
    assert daily.count() == 60 and daily.where("value = 0").count() == 2 + 2
    kept = series.trim_truncated_tail(daily)
    assert kept.agg(F.max("period")).first()[0] == days[56].date()


def test_seasonality_is_found(spark):
    rng = np.random.default_rng(1)
    y = np.tile([0, 0, 0, 0, 0, 50, 50], 20) + rng.normal(0, 1, 140)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "period": pd.date_range("2020-01-01", periods=140).date, "value": y}))
    assert series.seasonality(df).first()["seasonal_period"] == 7
    flat = df.withColumn("value", F.rand(5))
    assert series.seasonality(flat).first()["seasonal_period"] is None


def test_agreement_extremes(spark):
    df = spark.createDataFrame([(i % 4, "abcd"[i % 4], i // 10) for i in range(40)], "a int, b string, c int")
    same = rfm.agreement(df, "a", "b").first()
    assert same["adjusted_rand_index"] == 1.0 and same["normalised_mutual_information"] == 1.0
    assert abs(rfm.agreement(df, "a", "c").first()["adjusted_rand_index"]) < 0.15


def test_kmeans_invariants(spark):
    rng = np.random.default_rng(0)
    parts = [rng.normal(m, 0.1, (40, 2)) for m in (0, 5, 10)]
    pts = pd.DataFrame(np.vstack(parts), columns=["x", "y"])
    pts.insert(0, "customer_unique_id", np.arange(len(pts)))
    points = kmeans.point_frame(
        clusters.standardise(spark.createDataFrame(pts), ["x", "y"]), "customer_unique_id", ["x", "y"])
    scan = clusters.scan_k(points, [2, 3]).toPandas().set_index("k")
    assert scan.inertia[3] < scan.inertia[2] and scan.silhouette[3] > 0.9 and scan.converged.all()


def test_kpss_uses_as_many_lags_as_the_length_asks_for(spark):
    n = 12_500
    values = [((i * 7919) % 101) / 10 + (i % 7) for i in range(n)]
    days = spark.range(n).select(F.lit("a").alias("series_id"), F.expr("date_add(date'1980-01-01', cast(id as int))").alias("period"),
                                 ((F.col("id") * 7919 % 101) / 10 + F.col("id") % 7).alias("value"))
    e = [v - sum(values) / n for v in values]
    width, run, total = int(4 * (n / 100) ** 0.25), 0.0, 0.0
    for x in e:
        run += x
        total += run * run
    variance = sum(x * x for x in e) + 2 * sum((1 - k / (width + 1)) * sum(a * b for a, b in zip(e[k:], e)) for k in range(1, width + 1))
    assert width > 12
    assert series.kpss(days).first()["kpss_statistic"] == pytest.approx(total / n**2 / (variance / n), abs=1e-5)


def test_t_tails_at_few_and_very_many_degrees_of_freedom():
    from martlet.functions.tails import t_quantile, t_two_sided

    assert t_quantile(1 - 0.0001 / 2, 1) == pytest.approx(6366.1976, rel=1e-6)  # cot(pi alpha / 2)
    for t in (0.5, 1.96, 5.0):
        assert t_two_sided(t, 1e5 + 1) == pytest.approx(t_two_sided(t, 1e5 - 1), rel=1e-6)
    assert t_quantile(0.975, 1e12) == pytest.approx(1.959963984540054, rel=1e-10)
