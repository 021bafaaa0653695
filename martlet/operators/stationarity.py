"""Unit root and stationarity tests with lag terms for many series: one row per series, all arithmetic in JVM expressions.

A series' regressions share one matrix of lagged products. Its Cholesky factor holds every shorter regression in its leading
rows, so the sum of squares of each lag order is a suffix sum over the factor's last row and the order is chosen without a fit
per order. A regressor that earlier ones already explain gets a zero column and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.tails import normal_p
from martlet.operators.holt import packed
from martlet.operators.series import SERIES, regular

# The published approximation of the Dickey-Fuller distribution with a constant (MacKinnon 1994, 2010).
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
TAU_LOW = (2.1659, 1.4412, 0.038269)
TAU_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)

# The published KPSS critical values for level stationarity and their tail areas.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

#: A pivot below this share of its column's square sum counts as zero.
PIVOT_TOLERANCE = 1e-12

ADF_TYPE = "struct<lags:int,nobs:int,adf_statistic:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def _up_to(top: Column) -> Column:
    """1, ..., top; empty for 0."""
    return F.slice(F.sequence(F.lit(0), top), F.lit(2), top)


def products(columns: Column) -> Column:
    """Lower triangle of the inner products of an array of columns, row by row."""
    return F.transform(columns, lambda a, i: F.transform(F.slice(columns, F.lit(1), i + 1), lambda b: _dot(a, b)))


def cholesky(lower: Column) -> Column:
    """Lower factor of a matrix given by its lower triangle; columns without a pivot of their own are zero."""
    def entry(rows: Column, left: Column, g: Column) -> Column:
        def beside(row: Column) -> Column:
            pivot = F.get(row, F.size(left))
            return F.when(pivot > 0, (g - _dot(left, F.slice(row, F.lit(1), F.size(left)))) / pivot).otherwise(0.0)
        own = _let(g - _dot(left, left), lambda rest: F.when(rest > PIVOT_TOLERANCE * g, F.sqrt(rest)).otherwise(0.0))
        return F.when(F.size(left) == F.size(rows), own).otherwise(_let(F.get(rows, F.size(left)), beside))

    def row(rows: Column, given: Column) -> Column:
        made = F.aggregate(given, F.array().cast("array<double>"), lambda left, g: F.concat(left, F.array(entry(rows, left, g))))
        return F.concat(rows, F.array(made))
    return F.aggregate(lower, F.array().cast("array<array<double>>"), row)


def _regression(x: Column, d: Column, lags: Column, level_first: bool) -> Column:
    """Factor of constant, level, lagged differences and, last, the difference itself.

    ``x`` are the values, ``d`` their differences: row i holds d[i], x[i] and d[i - 1], ..., d[i - lags].
    """
    start, rows = lags + 1, F.size(d) - lags
    constant = F.array(F.array_repeat(F.lit(1.0), rows))
    level = F.array(F.slice(x, start, rows))
    lagged = F.transform(_up_to(lags), lambda k: F.slice(d, start - k, rows))
    target = F.array(F.slice(d, start, rows))
    parts = (constant, level, lagged, target) if level_first else (constant, lagged, level, target)
    return _let(F.concat(*parts), lambda columns: cholesky(products(columns)))


def _best_order(x: Column, d: Column, top: Column) -> Column:
    """Lag order up to ``top`` with the least Akaike criterion over common rows; the smaller one of equals."""
    rows = (F.size(d) - top).cast("double")

    def scored(fit: Column, p: Column) -> Column:
        rest = F.aggregate(F.slice(fit, p + 3, F.size(fit)), F.lit(0.0), lambda s, w: s + w * w)
        score = F.coalesce(rows * F.ln(rest / rows), F.lit(float("-inf"))) + 2 * (p + 2)
        return F.struct(score.alias("score"), p.alias("p"))
    return _let(F.element_at(_regression(x, d, top, True), -1),
                lambda fit: F.array_min(F.transform(F.sequence(F.lit(0), top), lambda p: scored(fit, p)))["p"])


def _statistic(x: Column, d: Column, lags: Column) -> Column:
    """t-statistic of the level in the regression with ``lags`` lagged differences."""
    def ratio(factor: Column) -> Column:
        fit, pivot = F.element_at(factor, -1), F.element_at(F.element_at(factor, -2), -1)
        free = (F.size(d) - 2 * lags - 2).cast("double")
        spread = F.element_at(fit, -1) / F.sqrt(free)
        value = F.when((free > 0) & (pivot > 0) & (spread > 0), F.element_at(fit, -2) / spread)
        return F.struct(lags.alias("lags"), (F.size(d) - lags).alias("nobs"), value.alias("adf_statistic"))
    return _let(_regression(x, d, lags, False), ratio)


def _adf(values: Column, lags: int | None) -> Column:
    """(lags, nobs, adf_statistic), NULL for too few values."""
    n = F.size(values)

    def tested(x: Column) -> Column:
        d = F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda b, a: b - a)
        top = F.least(F.floor(n / 2) - 2, F.ceil(12 * F.pow(n / 100.0, F.lit(0.25)))).cast("int")
        order = F.lit(lags) if lags is not None else None
        return _let(d, lambda steps: _let(_best_order(x, steps, top) if order is None else order, lambda p: _statistic(x, steps, p)))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    centred = _let(mean, lambda m: F.transform(values, lambda v: v - m))
    enough = n >= (4 if lags is None else 2 * lags + 4)
    return F.when(enough, _let(centred, tested)).otherwise(F.lit(None).cast(ADF_TYPE))


def _polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    value = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        value = value * x + term
    return value


def adf_columns() -> dict[str, Column]:
    """p-value and 5% critical value from columns ``adf_statistic`` and ``nobs``."""
    t, m = F.col("adf_statistic"), F.col("nobs").cast("double")
    z = F.when(t <= TAU_STAR, _polynomial(t, TAU_LOW)).otherwise(_polynomial(t, TAU_HIGH))
    below = F.when(z <= 0, normal_p(z) / 2).otherwise(1 - normal_p(z) / 2)
    return {"adf_p_value": F.when(t > TAU_MAX, 1.0).when(t < TAU_MIN, 0.0).when(t.isNotNull(), below),
            "critical_5_pct": _polynomial(1.0 / m, TAU_5_PERCENT)}


def augmented_dickey_fuller(series: DataFrame, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, per series.

    ``lags`` fixes the number of lagged differences; otherwise it is the one of least Akaike criterion up to
    ``min(n / 2 - 2, ceil(12 (n / 100)^(1/4)))``, compared over the rows that all orders have, and the statistic is taken over
    all rows of the chosen order. Missing values are left out. A series with too few values, or one whose level or error has no
    variance, keeps its row with a NULL statistic. Stationary means a p-value below 0.05.
    """
    tested = packed(regular(series)).select(SERIES, F.size("values").cast("bigint").alias("n"), _adf(F.col("values"), lags).alias("adf"))
    rated = tested.select(SERIES, "n", "adf.*").withColumns(adf_columns())
    return rated.select(
        SERIES, "n", F.col("lags").cast("bigint").alias("lags"), F.col("nobs").cast("bigint").alias("nobs"),
        F.round("adf_statistic", 6).alias("adf_statistic"), F.round("adf_p_value", 6).alias("p_value"),
        F.round("critical_5_pct", 6).alias("critical_5_pct"), (F.col("adf_p_value") < 0.05).alias("stationary"))


def _back(e: Column, k: Column) -> Column:
    """Product sum of a series with itself ``k`` steps back."""
    rows = F.size(e) - k
    return _dot(F.slice(e, k + 1, rows), F.slice(e, F.lit(1), rows))


def _kpss(values: Column) -> Column:
    """(kpss_lags, kpss_statistic) with the lag width taken from the first autocovariances (Hobijn, Franses, Ooms 1998)."""
    n = F.size(values)
    size = n.cast("double")

    def width(e: Column) -> Column:
        near = F.transform(_up_to(F.floor(F.pow(size, F.lit(2.0 / 9.0))).cast("int")), lambda k: F.struct(k.alias("k"), (_back(e, k) / (size / 2)).alias("g")))

        def ratio(found: Column) -> Column:
            weighted = F.aggregate(found, F.lit(0.0), lambda s, r: s + r["k"] * r["g"])
            return F.try_divide(weighted, F.aggregate(found, _dot(e, e) / size, lambda s, r: s + r["g"]))
        growth = _let(near, lambda found: _let(ratio(found), lambda q: 1.1447 * F.pow(q * q, F.lit(1.0 / 3.0))))
        return F.least(F.floor(growth * F.pow(size, F.lit(1.0 / 3.0))).cast("int"), n - 1)

    def tested(e: Column) -> Column:
        run = F.aggregate(e, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")),
                          lambda a, v: F.struct((a["s"] + v).alias("s"), (a["ss"] + (a["s"] + v) * (a["s"] + v)).alias("ss")))["ss"]

        def rated(lags: Column) -> Column:
            variance = (_dot(e, e) + 2 * F.aggregate(_up_to(lags), F.lit(0.0), lambda s, k: s + (1 - k / (lags + 1.0)) * _back(e, k))) / size
            return F.struct(lags.alias("kpss_lags"), F.try_divide(run / (size * size), variance).alias("kpss_statistic"))
        return _let(width(e), lambda lags: F.when(lags.isNotNull(), rated(lags)))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / size
    return _let(_let(mean, lambda m: F.transform(values, lambda v: v - m)), tested)


def kpss_p_value(stat: Column) -> Column:
    """Tail area by linear interpolation in the published table; its ends are bounds, not values."""
    value = F.when(stat <= KPSS_CRITICAL[0][0], KPSS_CRITICAL[0][1])
    for (low, above), (high, below) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]):
        value = value.when(stat <= high, above + (stat - low) * ((below - above) / (high - low)))
    return value.when(stat.isNotNull(), KPSS_CRITICAL[-1][1])


def _season(values: Column, period: int) -> Column:
    """(a, o): mean autocorrelation of the differences at multiples of the period, mean absolute one at other lags."""
    n, top = F.size(values), 4 * period + 2

    def correlated(c: Column) -> Column:
        square = _dot(c, c)
        lags = _up_to(F.least(F.lit(top), F.size(c) - 2))
        return _let(square, lambda s0: F.transform(lags, lambda k: F.struct(k.alias("k"), F.try_divide(_back(c, k), s0).alias("r"))))

    def mean_of(found: Column, wanted: Callable[[Column], Column], of: Callable[[Column], Column]) -> Column:
        return _let(F.filter(found, lambda f: wanted(f["k"])), lambda some: F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, f: s + of(f["r"])), F.size(some)))

    def rated(found: Column) -> Column:
        at = mean_of(found, lambda k: (k % period == 0) & (k <= 4 * period), lambda r: r)
        return F.struct(at.alias("a"), mean_of(found, lambda k: k % period != 0, F.abs).alias("o"))
    steps = F.zip_with(F.slice(values, F.lit(2), n - 1), F.slice(values, F.lit(1), n - 1), lambda b, a: b - a)
    centred = _let(steps, lambda d: _let(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d), lambda m: F.transform(d, lambda v: v - m)))
    return F.when(n > 4 * period, _let(_let(centred, correlated), rated))


def diagnosis(series: DataFrame, period: int = 7) -> DataFrame:
    """One row per series: both tests, the seasonal check at ``period`` and whether the tests disagree.

    ``kpss_bound`` is '<' or '>' where the p-value is the end of the published table. ``tests_disagree`` (stationary by
    Dickey-Fuller, not by KPSS) hints at a trend. Series of up to four periods are not judged for seasonality.
    """
    values = F.col("values")
    rows = packed(regular(series)).select(
        SERIES, F.size("values").cast("bigint").alias("n"), _adf(values, None).alias("adf"), _kpss(values).alias("kpss"), _season(values, period).alias("season"))
    rated = rows.select(SERIES, "n", "adf.*", "kpss.*", "season.*").withColumns(adf_columns())
    p = kpss_p_value(F.col("kpss_statistic"))
    stationary = F.col("adf_p_value") < 0.05
    return rated.select(
        SERIES, "n", F.col("lags").cast("bigint").alias("lags"), F.round("adf_statistic", 6).alias("adf_statistic"), F.round("adf_p_value", 6).alias("adf_p_value"),
        stationary.alias("stationary"), F.col("kpss_lags").cast("bigint").alias("kpss_lags"),
        F.round("kpss_statistic", 6).alias("kpss_statistic"), F.round(p, 6).alias("kpss_p_value"),
        F.when(p >= KPSS_CRITICAL[0][1], ">").when(p <= KPSS_CRITICAL[-1][1], "<").alias("kpss_bound"),
        (stationary & (p < 0.05)).alias("tests_disagree"), F.round("a", 6).alias("acf_at_period"), F.round("o", 6).alias("abs_acf_elsewhere"),
        F.when(F.col("a") > 3 * F.col("o"), F.lit(period).cast("bigint")).alias("seasonal_period"))
