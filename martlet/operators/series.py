"""Many regular time series at once: build, trim, diagnose.

A series is the rows of one ``series_id``; facts are summed per series and period before anything
else, so a series is never longer than its calendar, and series are the unit of parallel work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from martlet.functions.numbers import big, total

SERIES = "series_id"


def by_time() -> WindowSpec:
    return Window.partitionBy(SERIES).orderBy("period")


def daily_series(orders: DataFrame, series: Column, ts: str = "order_timestamp", amount: str = "revenue") -> DataFrame:
    """Daily totals per series; days without an order between first and last are zero."""
    sums = orders.groupBy(series.alias(SERIES), F.to_date(ts).alias("period")).agg(
        total(amount).alias("value"), F.count(F.lit(1)).alias("orders"))
    span = sums.groupBy(SERIES).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    spine = span.select(SERIES, F.explode(F.sequence("first", "last")).alias("period"))
    return spine.join(sums, [SERIES, "period"], "left").select(
        SERIES, "period", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"))


def monthly_series(orders: DataFrame, series: Column, ts: str = "order_timestamp", amount: str = "revenue") -> DataFrame:
    """Monthly totals per series by month start; a month without an order is present but NULL."""
    start = F.to_date(F.trunc(F.to_date(ts), "month"))
    sums = orders.groupBy(series.alias(SERIES), start.alias("period")).agg(
        total(amount).alias("value"), F.count(F.lit(1)).alias("orders"))
    span = sums.groupBy(SERIES).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    month = F.expr("interval 1 month")
    spine = span.select(SERIES, F.explode(F.sequence("first", "last", month)).alias("period"))
    return spine.join(sums, [SERIES, "period"], "left").select(SERIES, "period", "value", "orders")


def tail_health(daily: DataFrame, window: int = 28) -> DataFrame:
    """Order count against the rolling median of the last ``window`` days, NULL before a full window."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(frame) == window
    middle = F.when(full, F.percentile("orders", F.lit(0.5)).over(frame))
    return daily.withColumn("rolling_median", middle).withColumn(
        "health", F.try_divide(F.col("orders").cast("double"), F.col("rolling_median")))


def trim_truncated_tail(daily: DataFrame, min_ratio: float = 0.5, window: int = 28) -> DataFrame:
    """Drop the days after the last healthy one; a series that never was healthy stays whole."""
    rated = tail_health(daily, window)
    healthy = F.when(F.col("health") >= min_ratio, F.col("period"))
    last_good = F.max(healthy).over(Window.partitionBy(SERIES))
    kept = rated.withColumn("last_good", last_good)
    return kept.where(F.col("last_good").isNull() | (F.col("period") <= F.col("last_good"))).drop(
        "rolling_median", "health", "last_good")


def trim_report(daily: DataFrame, min_ratio: float = 0.5, window: int = 28) -> DataFrame:
    """Per series: last healthy day, days and value removed."""
    healthy = F.when(F.col("health") >= min_ratio, F.col("period"))
    rated = tail_health(daily, window).withColumn("last_good", F.max(healthy).over(Window.partitionBy(SERIES)))
    lost = F.coalesce(F.col("period") > F.col("last_good"), F.lit(False))
    return rated.groupBy(SERIES).agg(
        F.max("period").alias("last_day"), F.max("last_good").alias("last_healthy_day"),
        F.count_if(lost).alias("days_removed"),
        F.round(F.coalesce(F.sum(F.when(lost, F.col("value"))), F.lit(0.0)), 2).alias("value_removed"),
        F.round(F.sum("value"), 2).alias("value_total"))


def rolling_mean(series: DataFrame, window: int = 7) -> DataFrame:
    """Trailing mean, NULL before a full window."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    full = F.count("value").over(frame) == window
    return series.withColumn(f"rolling_mean_{window}", F.round(F.when(full, F.avg("value").over(frame)), 4))


def weekday_index(daily: DataFrame) -> DataFrame:
    """Mean of each weekday relative to the mean of the weekday means, 100 is average."""
    means = daily.groupBy(SERIES, (F.weekday("period") + 1).cast("bigint").alias("weekday_number")).agg(F.avg("value").alias("mean"))
    level = F.avg("mean").over(Window.partitionBy(SERIES))
    return means.select(SERIES, "weekday_number", F.round("mean", 4).alias("mean_value"),
                        F.round(F.try_divide(100.0 * F.col("mean"), level), 4).alias("index"))


def differences(series: DataFrame) -> DataFrame:
    """First differences in time order, without the first row."""
    return series.withColumn("value", F.col("value") - F.lag("value").over(by_time())).where(F.col("value").isNotNull())


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """Autocorrelation per series and lag, around the series mean."""
    centred = series.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy(SERIES)))
    lagged = centred.withColumns({f"l{k}": F.lag("c", k).over(by_time()) for k in range(1, max_lag + 1)})
    sums = lagged.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * F.col("c")).alias("s0"),
        *[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    lags = [F.struct(F.lit(k).cast("bigint").alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf"))
            for k in range(1, max_lag + 1)]
    return sums.select(SERIES, "n", F.inline(F.array(*lags))).where(F.col("lag") < F.col("n"))


def seasonality(series: DataFrame, period: int = 7) -> DataFrame:
    """Is the differenced series seasonal at ``period``?

    Yes when the mean autocorrelation at multiples of the period exceeds three times the mean
    absolute autocorrelation elsewhere. Short series (up to four periods) are not judged.
    """
    diffed = differences(series)
    top = 4 * period + 2
    usable = F.least(F.lit(top), F.col("n") - 2)
    lags = autocorrelation(diffed, top).where(F.col("lag") <= usable)
    at = (F.col("lag") % period == 0) & (F.col("lag") <= 4 * period)
    off = F.col("lag") % period != 0
    # n counts differences, the series itself is one longer
    judged = F.col("n") + 1 > 4 * period
    s = lags.where(judged).groupBy(SERIES).agg(
        (F.max("n") + 1).alias("observations"), F.avg(F.when(at, F.col("acf"))).alias("a"),
        F.avg(F.when(off, F.abs("acf"))).alias("o"))
    return s.select(SERIES, "observations", F.round("a", 6).alias("acf_at_period"), F.round("o", 6).alias("abs_acf_elsewhere"),
                    F.when(F.col("a") > 3 * F.col("o"), F.lit(period).cast("bigint")).alias("seasonal_period"))


def dickey_fuller(series: DataFrame) -> DataFrame:
    """Dickey-Fuller t-statistic without lags: regression of the difference on the level.

    Compared with published 5% critical value -2.86 (constant, no trend, large sample).
    """
    level = F.lag("value").over(by_time())
    rows = series.withColumns({"x": level, "y": F.col("value") - level}).where(F.col("y").isNotNull())
    s = rows.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    n = F.col("n").cast("double")
    sse = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    se = F.sqrt(F.try_divide(F.try_divide(sse, n - 2), F.col("sxx")))
    return s.where(n > 2).withColumn("t", F.try_divide(F.col("b"), se)).select(
        SERIES, "n", F.round("t", 6).alias("df_statistic"), (F.col("t") < -2.86).alias("stationary"))


def kpss(series: DataFrame, lags: int | None = None) -> DataFrame:
    """KPSS level-stationarity statistic with Bartlett weights.

    ``lags`` defaults per series to ``floor(4 (n/100)^(1/4))``. Compared with the published 5%
    critical value 0.463.
    """
    mean_over = Window.partitionBy(SERIES)
    resid = series.where(F.col("value").isNotNull()).withColumns({
        "e": F.col("value") - F.avg("value").over(mean_over), "n": F.count("value").over(mean_over)})
    partial = resid.withColumn("s", F.sum("e").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    width = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(0.25)))
    placed = partial.withColumns({"at": F.row_number().over(by_time()), "width": width.cast("int")})
    s = placed.groupBy(SERIES).agg(
        F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("e") * F.col("e")).alias("g0"))
    later = placed.where("width > 0").select(
        F.col(SERIES).alias("_id"), "e", "at", "width", F.explode(F.sequence(F.lit(1), "width")).alias("k"))
    earlier = placed.select(F.col(SERIES).alias("_other"), F.col("e").alias("e_back"), F.col("at").alias("at_back"))
    weight = 1.0 - F.col("k") / (F.col("width") + 1.0)
    products = later.join(earlier, F.col("_id").eqNullSafe(F.col("_other")) & (F.col("at") - F.col("k") == F.col("at_back"))).groupBy("_id").agg(
        F.sum(weight * F.col("e") * F.col("e_back")).alias("g"))
    s = s.join(products, F.col(SERIES).eqNullSafe(F.col("_id")), "left")
    variance = F.col("g0") + 2.0 * F.coalesce("g", F.lit(0.0))
    n = F.col("n").cast("double")
    stat = F.try_divide(F.col("ss") / (n * n), variance / n)
    return s.select(SERIES, "n", F.round(stat, 6).alias("kpss_statistic"), (stat < 0.463).alias("level_stationary"))


def split_tail(series: DataFrame, test: int) -> DataFrame:
    """Mark the last ``test`` periods of each series: ``is_test`` and the step within the test."""
    back = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("period")))
    n = F.count(F.lit(1)).over(Window.partitionBy(SERIES))
    return series.withColumns({"_back": back, "_n": n}).select(
        *series.columns, (F.col("_back") <= test).alias("is_test"),
        big(F.lit(test) - F.col("_back") + 1).alias("step"),
        big(F.col("_n") - F.col("_back") + 1).alias("position"))


def regular(series: DataFrame, columns: Sequence[str] = (SERIES, "period", "value")) -> DataFrame:
    """Only the columns that models read, without missing values."""
    return series.select(*columns).where(F.col("value").isNotNull())
