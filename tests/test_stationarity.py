"""Stationarity tests against least squares in numpy and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest

from martlet.operators import series, stationarity


def regressed(x, lags, level=True):
    """(t of the level, residual sum, rows) by numpy's least squares."""
    d = np.diff(x)
    y = d[lags:]
    cols = [np.ones(len(y)), x[lags:-1]] + [d[lags - k:len(d) - k] for k in range(1, lags + 1)]
    z = np.column_stack(cols)
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    sse = float(((y - z @ b) ** 2).sum())
    cov = np.linalg.inv(z.T @ z) * sse / (len(y) - z.shape[1])
    return b[1] / math.sqrt(cov[1, 1]), sse, len(y)


def chosen(x):
    n = len(x)
    top = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    d, scores = np.diff(x), []
    y = d[top:]
    for p in range(top + 1):
        z = np.column_stack([np.ones(len(y)), x[top:-1]] + [d[top - k:len(d) - k] for k in range(1, p + 1)])
        r = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        scores.append(len(y) * math.log(float(r @ r) / len(y)) + 2 * (p + 2))
    return int(np.argmin(scores))


def made():
    rng = np.random.default_rng(11)
    noise = rng.normal(0, 1, 400)
    ar = np.zeros(400)
    for t in range(2, 400):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + noise[t]
    return {"walk": 1e6 + np.cumsum(noise) * 1e3, "ar": ar, "short": rng.normal(5, 2, 12), "tiny": rng.normal(5, 2, 4), "white": noise[:150],
            "weekly": np.tile([0, 0, 0, 0, 0, 50, 50], 20) + rng.normal(0, 1, 140)}


@pytest.fixture(scope="module")
def frame(spark):
    parts = [pd.DataFrame({"series_id": k, "period": pd.date_range("2020-01-01", periods=len(v)).date, "value": v}) for k, v in made().items()]
    days = pd.date_range("2020-01-01", periods=30).date
    flat = pd.DataFrame({"series_id": "flat", "period": days, "value": 7.0})
    line = pd.DataFrame({"series_id": "line", "period": days, "value": np.arange(30.0)})
    few = pd.DataFrame({"series_id": "few", "period": days[:2], "value": [1.0, 2.0]})
    return spark.createDataFrame(pd.concat([*parts, flat, line, few])).repartition(3)


def test_lag_order_and_statistic(frame):
    got = {r["series_id"]: r for r in stationarity.augmented_dickey_fuller(frame).collect()}
    for name, x in made().items():
        lags = chosen(x)
        t, _, rows = regressed(x, lags)
        assert (got[name]["lags"], got[name]["nobs"]) == (lags, rows), name
        assert got[name]["adf_statistic"] == pytest.approx(t, abs=2e-6), name
    assert got["ar"]["stationary"] and not got["walk"]["stationary"]
    for name in ("flat", "line", "few"):
        assert got[name]["adf_statistic"] is None and got[name]["stationary"] is None


def test_fixed_lags(frame):
    for lags in (0, 1, 2):
        got = {r["series_id"]: r for r in stationarity.augmented_dickey_fuller(frame, lags).collect()}
        for name, x in made().items():
            if len(x) >= 2 * lags + 4:
                assert got[name]["adf_statistic"] == pytest.approx(regressed(x, lags)[0], rel=1e-4, abs=2e-6), (name, lags)
            else:
                assert got[name]["adf_statistic"] is None
    plain = {r["series_id"]: r["df_statistic"] for r in series.dickey_fuller(frame).collect()}
    none = {r["series_id"]: r["adf_statistic"] for r in stationarity.augmented_dickey_fuller(frame, 0).collect()}
    assert all(none[k] == pytest.approx(plain[k], abs=2e-6) for k in made())


def test_one_and_two_lags_by_partial_regression(frame):
    """The level's coefficient is that of residuals on residuals, whatever the lags take away."""
    x = made()["ar"]
    d = np.diff(x)
    for lags in (1, 2):
        y, level = d[lags:], x[lags:-1]
        others = np.column_stack([np.ones(len(y))] + [d[lags - k:len(d) - k] for k in range(1, lags + 1)])
        take = lambda v: v - others @ np.linalg.solve(others.T @ others, others.T @ v)
        ry, rx = take(y), take(level)
        b = (rx @ ry) / (rx @ rx)
        t = b / math.sqrt(((ry - b * rx) ** 2).sum() / (len(y) - lags - 2) / (rx @ rx))
        got = stationarity.augmented_dickey_fuller(frame.where("series_id = 'ar'"), lags).first()
        assert got["adf_statistic"] == pytest.approx(t, abs=2e-6)


def test_published_points(spark):
    """The 5% point of the large-sample distribution has a tail area of 5%; a table's ends are bounds."""
    df = spark.createDataFrame([(-2.86154, 10**9), (-3.43035, 10**9), (-2.56677, 10**9), (3.0, 9), (-20.0, 9), (None, None)], "adf_statistic double, nobs bigint")
    p = [r["adf_p_value"] for r in df.withColumns(stationarity.adf_columns()).collect()]
    assert p[:3] == [pytest.approx(0.05, abs=5e-4), pytest.approx(0.01, abs=5e-4), pytest.approx(0.10, abs=5e-4)]
    assert p[3:] == [1.0, 0.0, None]


def test_diagnosis(frame):
    got = {r["series_id"]: r for r in stationarity.diagnosis(frame).collect()}
    season = {r["series_id"]: r for r in series.seasonality(frame).collect()}
    for name, x in made().items():
        e, n = x - x.mean(), len(x)
        back = lambda k: float(e[k:] @ e[:n - k])
        near = [back(k) / (n / 2) for k in range(1, int(n ** (2 / 9)) + 1)]
        ratio = sum(k * g for k, g in enumerate(near, 1)) / (float(e @ e) / n + sum(near))
        lags = min(int(1.1447 * (ratio**2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        variance = (float(e @ e) + 2 * sum((1 - k / (lags + 1)) * back(k) for k in range(1, lags + 1))) / n
        stat = float((np.cumsum(e) ** 2).sum()) / n**2 / variance
        assert got[name]["kpss_lags"] == lags and got[name]["kpss_statistic"] == pytest.approx(stat, abs=2e-6), name
        assert got[name]["kpss_p_value"] == pytest.approx(np.interp(stat, [c for c, _ in stationarity.KPSS_CRITICAL], [p for _, p in stationarity.KPSS_CRITICAL]), abs=2e-6)
        if name in season:
            assert got[name]["acf_at_period"] == pytest.approx(season[name]["acf_at_period"], abs=2e-6)
            assert got[name]["seasonal_period"] == season[name]["seasonal_period"]
    assert got["weekly"]["seasonal_period"] == 7 and got["walk"]["kpss_bound"] == "<"
    assert got["flat"]["kpss_statistic"] is None and got["flat"]["tests_disagree"] is None
    assert stationarity.diagnosis(frame.limit(0)).count() == 0
