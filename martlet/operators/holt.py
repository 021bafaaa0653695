"""Exponential smoothing with trend and season for many series: folds inside the JVM, the grid inside each series' row.

Holt's level and trend are linear in the two starting values, so a fold carries each as a constant and two coefficients, with
the sums of the normal equations; the best start and its error sum follow in closed form for every grid point. Holt-Winters
starts from its first two seasons: the level is the mean of the first, the trend the mean step from the first to the second,
and the seasonal terms are the first season's distances from its mean. A series' array is never copied for the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.operators.series import SERIES

# Model names of the ladder.
HOLT, HOLT_DAMPED, HOLT_WINTERS = "Holt (additive trend)", "Holt (damped trend)", "Holt-Winters (seasonal)"

#: Grids of the smoothing weights (alpha, beta, gamma) and of the damping (phi).
ALPHAS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
BETAS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
PHIS, SEASON_PHIS = (0.8, 0.85, 0.9, 0.94, 0.96, 0.98), (0.9, 0.98)
GAMMAS = (0.0, 0.05, 0.1, 0.2, 0.4)


def packed(train: DataFrame) -> DataFrame:
    """One row per series: its values in time order."""
    rows = train.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("rows"))
    return rows.select(SERIES, F.transform("rows", lambda r: r["value"].cast("double")).alias("values"))


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _grid(alphas: Sequence[float], betas: Sequence[float], phis: Sequence[float], gammas: Sequence[float]) -> Column:
    """Array of all (alpha, beta, phi, gamma), the last changing first."""
    return F.flatten(F.transform(_numbers(alphas), lambda a: F.flatten(F.transform(_numbers(betas), lambda b: F.flatten(F.transform(
        _numbers(phis), lambda p: F.transform(_numbers(gammas), lambda g: F.struct(a.alias("alpha"), b.alias("beta"), p.alias("phi"), g.alias("gamma")))))))))


def _named(**fields: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _trend_fit(values: Column, g: Column) -> Column:
    """(sse, alpha, beta, phi, level, trend) of one grid point, with the least-squares start; sse is infinite without one."""
    start = _named(c=0.0, c1=1.0, c2=0.0, t=0.0, t1=0.0, t2=1.0, aa=0.0, ab=0.0, bb=0.0, ra=0.0, rb=0.0, sq=0.0)
    keep, turn = 1.0 - g["alpha"], g["alpha"] * g["beta"]

    def step(s: Column, y: Column) -> Column:
        trend, t1, t2 = s["t"] * g["phi"], s["t1"] * g["phi"], s["t2"] * g["phi"]
        error, g1, g2 = y - s["c"] - trend, s["c1"] + t1, s["c2"] + t2
        return _named(
            c=s["c"] + trend + g["alpha"] * error, c1=keep * g1, c2=keep * g2, t=trend + turn * error, t1=t1 - turn * g1, t2=t2 - turn * g2,
            aa=s["aa"] + g1 * g1, ab=s["ab"] + g1 * g2, bb=s["bb"] + g2 * g2, ra=s["ra"] + g1 * error, rb=s["rb"] + g2 * error, sq=s["sq"] + error * error)

    def finish(s: Column) -> Column:
        det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
        sound = F.when(det > 1e-10 * s["aa"] * s["bb"], det)
        level0 = F.try_divide(s["ra"] * s["bb"] - s["rb"] * s["ab"], sound)
        trend0 = F.try_divide(s["aa"] * s["rb"] - s["ab"] * s["ra"], sound)
        return _named(sse=F.coalesce(s["sq"] - level0 * s["ra"] - trend0 * s["rb"], F.lit(float("inf"))), alpha=g["alpha"], beta=g["beta"], phi=g["phi"], gamma=g["gamma"],
                      level=s["c"] + s["c1"] * level0 + s["c2"] * trend0, trend=s["t"] + s["t1"] * level0 + s["t2"] * trend0, season=F.array().cast("array<double>"))

    return F.aggregate(values, start, step, finish)


def _season_fit(values: Column, g: Column, m: int) -> Column:
    """(sse, alpha, beta, phi, gamma, level, trend, season) of one grid point, from the first two seasons."""
    first, second = F.slice(values, 1, m), F.slice(values, m + 1, m)
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / float(m)
    start = _named(level=mean(first), trend=(mean(second) - mean(first)) / float(m), season=F.transform(first, lambda v: v - mean(first)), sse=0.0)

    def step(s: Column, y: Column) -> Column:
        trend, now = s["trend"] * g["phi"], F.element_at(s["season"], 1)
        error = y - s["level"] - trend - now
        return _named(level=s["level"] + trend + g["alpha"] * error, trend=trend + g["alpha"] * g["beta"] * error,
                      season=F.concat(F.slice(s["season"], 2, m - 1), F.array(now + g["gamma"] * error)), sse=s["sse"] + error * error)

    return F.aggregate(values, start, step, lambda s: _named(
        sse=s["sse"], alpha=g["alpha"], beta=g["beta"], phi=g["phi"], gamma=g["gamma"], level=s["level"], trend=s["trend"], season=s["season"]))


def best_holt(train: DataFrame, damped: bool, season: int = 0) -> DataFrame:
    """One row per series: n, values and best (the grid point of least error sum, the first on a tie; NULL for short series).

    Holt needs four values, Holt-Winters two whole seasons.
    """
    phis = (SEASON_PHIS if season else PHIS) if damped else (1.0,)
    grid = _grid(ALPHAS, BETAS, phis, GAMMAS if season else (0.0,))
    rows = packed(train).withColumn("n", F.size("values").cast("bigint"))
    fit = (lambda g: _season_fit(F.col("values"), g, season)) if season else (lambda g: _trend_fit(F.col("values"), g))
    best = F.array_min(F.transform(grid, fit))
    return rows.select(SERIES, "n", F.when(F.col("n") >= max(4, 2 * season), best).alias("best"))


def holt_forecast(train: DataFrame, horizon: int, model: str, damped: bool, season: int = 0) -> DataFrame:
    """(series_id, model, step, forecast); the forecast of a series that is too short is NULL."""
    best = F.col("best")
    phis = F.transform(F.sequence(F.lit(1), F.col("step").cast("int")), lambda i: F.pow(best["phi"], i.cast("double")))
    ahead = best["level"] + best["trend"] * F.aggregate(phis, F.lit(0.0), lambda a, v: a + v)
    if season:
        ahead = ahead + F.get(best["season"], (F.col("step") - 1) % season)
    stepped = best_holt(train, damped, season).withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return stepped.select(SERIES, F.lit(model).alias("model"), "step", ahead.alias("forecast"))


def holt_family(train: DataFrame, horizon: int, season: int = 0) -> DataFrame:
    """Holt, damped Holt and, with a season, damped Holt-Winters."""
    out = holt_forecast(train, horizon, HOLT, False).unionByName(holt_forecast(train, horizon, HOLT_DAMPED, True))
    return out.unionByName(holt_forecast(train, horizon, HOLT_WINTERS, True, season)) if season else out
