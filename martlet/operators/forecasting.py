"""Forecasts for many series: baselines, exponential smoothing, two ARIMA forms, a model ladder.

Models return ``(series_id, model, step, forecast)``; where a series is too short for a model, its
forecasts are NULL and it is ranked last. Baselines and ARIMA(1,1,0) are grouped aggregates. Simple
smoothing folds each series once per grid value inside the JVM (see ``martlet.operators.holt``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.functions.numbers import pct
from martlet.operators.holt import holt_family, packed
from martlet.operators.series import SERIES, by_time

# Model names of the ladder.
NAIVE, MEAN, MOVING, DRIFT = "Naive (last value)", "Mean (all history)", "Moving average (3)", "Drift"
SES, ARIMA_011, ARIMA_110 = "Simple exp smoothing", "ARIMA(0, 1, 1)", "ARIMA(1, 1, 0)"


def _steps(df: DataFrame, model: str, horizon: int, forecast: Column) -> DataFrame:
    """One row per step 1..horizon; ``forecast`` may use the column ``step``."""
    stepped = df.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return stepped.select(SERIES, F.lit(model).alias("model"), "step", forecast.alias("forecast"))


def _ends(train: DataFrame) -> DataFrame:
    ordered = train.withColumns({"at": F.row_number().over(by_time()),
                                 "back": F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("period")))})
    return ordered.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max_by("value", "period").alias("last"),
        F.min_by("value", "period").alias("first"), F.avg(F.when(F.col("back") <= 3, F.col("value"))).alias("last3"))


def baselines(train: DataFrame, horizon: int) -> DataFrame:
    """Last value, mean, mean of the last three, and straight-line drift."""
    ends = _ends(train)
    slope = F.coalesce(F.try_divide(F.col("last") - F.col("first"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    kinds = [(NAIVE, F.col("last")), (MEAN, F.col("mean")), (MOVING, F.col("last3")),
             (DRIFT, F.col("last") + slope * F.col("step"))]
    stepped = ends.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return stepped.select(SERIES, "step", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), value.alias("forecast")) for name, value in kinds]))).select(
        SERIES, "model", "step", "forecast")


def seasonal_naive(train: DataFrame, horizon: int, period: int) -> DataFrame:
    """Repeat the last full season."""
    back = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("period")))
    last = train.withColumn("back", back).where(F.col("back") <= period).withColumn(
        "slot", (F.lit(period) - F.col("back") + 1).cast("bigint"))
    cycles = F.sequence(F.col("slot"), F.lit(max(horizon, period)).cast("bigint"), F.lit(period).cast("bigint"))
    return last.select(SERIES, F.lit(f"Seasonal naive ({period})").alias("model"), F.explode(cycles).alias("step"),
                       F.col("value").alias("forecast")).where(F.col("step") <= horizon)


def smoothing_grid(train: DataFrame, low: int, high: int, per_unit: int) -> DataFrame:
    """Per series the error sum and final level of simple smoothing for every alpha = k/per_unit, low <= k <= high.

    The starting level is the least-squares one. With level and errors linear in the start l0, the
    fold carries the level for l0 = 0, the weight left on l0 and three sums; the best l0 and its
    error sum follow in closed form.
    """
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("w"), F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))

    def fit(k: Column) -> Column:
        alpha = k / F.lit(float(per_unit))

        def step(acc: Column, y: Column) -> Column:
            b = y - acc["s"]
            return F.struct((acc["s"] * (1.0 - alpha) + alpha * y).alias("s"), (acc["w"] * (1.0 - alpha)).alias("w"),
                            (acc["ab"] + acc["w"] * b).alias("ab"), (acc["aa"] + acc["w"] * acc["w"]).alias("aa"),
                            (acc["bb"] + b * b).alias("bb"))

        def finish(acc: Column) -> Column:
            return F.struct((acc["bb"] - F.try_divide(acc["ab"] * acc["ab"], acc["aa"])).alias("sse"), alpha.alias("alpha"),
                            (acc["s"] + acc["w"] * F.try_divide(acc["ab"], acc["aa"])).alias("level"))

        return F.aggregate("values", start, step, finish)

    return packed(train).select(SERIES, F.size("values").cast("bigint").alias("n"), F.transform(F.sequence(F.lit(low), F.lit(high)), fit).alias("fits"))


def best_smoothing(train: DataFrame, low: int, high: int, per_unit: int) -> DataFrame:
    """The grid value with the smallest error sum per series (the smallest alpha on a tie)."""
    return smoothing_grid(train, low, high, per_unit).select(SERIES, "n", F.array_min("fits").alias("b")).select(SERIES, "b.alpha", "n", "b.sse", "b.level")


def simple_smoothing(train: DataFrame, horizon: int, per_unit: int = 100) -> DataFrame:
    """Flat forecast at the final level, alpha on a grid of 1/per_unit in (0, 1]."""
    return _steps(best_smoothing(train, 1, per_unit, per_unit), SES, horizon, F.col("level"))


def arima_011(train: DataFrame, horizon: int, per_unit: int = 100, z: float = 1.959963984540054) -> DataFrame:
    """ARIMA(0,1,1) as smoothing with alpha = 1 + theta over the invertible range, with interval.

    The variance of step h is ``s2 (1 + (h-1) alpha^2)``.
    """
    best = best_smoothing(train, 1, 2 * per_unit - 1, per_unit)
    s2 = F.try_divide(F.col("sse"), (F.col("n") - 1).cast("double"))
    reach = z * F.sqrt(s2 * (1.0 + (F.col("step") - 1) * F.col("alpha") * F.col("alpha")))
    stepped = best.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return stepped.select(SERIES, F.lit(ARIMA_011).alias("model"), "step", F.col("level").alias("forecast"),
                          (F.col("level") - reach).alias("lower_95"), (F.col("level") + reach).alias("upper_95"))


def arima_110(train: DataFrame, horizon: int) -> DataFrame:
    """ARIMA(1,1,0): least-squares autoregression of the differences without constant."""
    d = train.withColumn("d", F.col("value") - F.lag("value").over(by_time()))
    pairs = d.withColumn("d0", F.lag("d").over(by_time()))
    s = pairs.groupBy(SERIES).agg(
        F.max_by("value", "period").alias("last"), F.max_by("d", "period").alias("last_d"),
        F.try_divide(F.sum(F.col("d") * F.col("d0")), F.sum(F.when(F.col("d0").isNotNull(), F.col("d0") * F.col("d0")))).alias("phi"))
    powers = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("t")),
                         lambda acc, _: F.struct((acc["p"] * F.col("phi")).alias("p"), (acc["t"] + acc["p"] * F.col("phi")).alias("t")),
                         lambda acc: acc["t"])
    return _steps(s, ARIMA_110, horizon, F.col("last") + F.col("last_d") * powers)


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE and MAPE; MAPE is NULL when any actual value is practically zero."""
    gap = actual - predicted
    safe = F.count_if(F.abs(actual) < 1e-9) == 0
    return {"MAE": F.avg(F.abs(gap)), "RMSE": F.sqrt(F.avg(gap * gap)),
            "MAPE_pct": F.when(safe, F.avg(F.abs(F.try_divide(gap, actual))) * 100.0)}


def score(forecasts: DataFrame, test: DataFrame, digits: int = 4) -> DataFrame:
    """Models ranked by MAE per series, with the difference to the naive forecast."""
    joined = forecasts.join(test.select(SERIES, "step", "value"), [SERIES, "step"])
    m = joined.groupBy(SERIES, "model").agg(*[c.alias(n) for n, c in error_metrics(F.col("value"), F.col("forecast")).items()])
    of_series = Window.partitionBy(SERIES)
    naive = F.max(F.when(F.col("model") == NAIVE, F.col("MAE"))).over(of_series)
    ranked = m.withColumns({"naive": naive, "rank": F.row_number().over(of_series.orderBy(F.asc_nulls_last(F.round("MAE", digits)), "model"))})
    return ranked.select(
        SERIES, "model", *[F.round(c, digits).alias(c) for c in ("MAE", "RMSE", "MAPE_pct")],
        (F.round(pct("MAE", "naive") - 100.0, digits) + 0.0).alias("vs_naive_pct"), F.col("rank").cast("bigint").alias("rank"))


def forecasts_for(train: DataFrame, horizon: int, season: int | None = None, holt: bool = True) -> DataFrame:
    """Every model of the ladder."""
    parts = [baselines(train, horizon), simple_smoothing(train, horizon),
             arima_011(train, horizon).select(SERIES, "model", "step", "forecast"), arima_110(train, horizon)]
    if season:
        parts.append(seasonal_naive(train, horizon, season))
    if holt:
        parts.append(holt_family(train, horizon, season or 0))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(split: DataFrame, horizon: int, season: int | None = None, holt: bool = True) -> DataFrame:
    """Fit on the training part and score on the test part. Input comes from ``split_tail``."""
    train = split.where(~F.col("is_test"))
    return score(forecasts_for(train, horizon, season, holt), split.where(F.col("is_test")))


def history_and_forecast(monthly: DataFrame, horizon: int = 3) -> DataFrame:
    """Actual months followed by the ARIMA(0,1,1) forecast months, one continuous ``value``."""
    rows = monthly.where(F.col("value").isNotNull())
    none = F.lit(None).cast("double")
    past = rows.select(SERIES, "period", F.lit("actual").alias("type"), F.col("value").alias("actual"),
                       none.alias("forecast"), none.alias("lower_95"), none.alias("upper_95"))
    ends = rows.groupBy(SERIES).agg(F.max("period").alias("end"))
    ahead = arima_011(rows, horizon).join(ends, SERIES).select(
        SERIES, F.add_months("end", F.col("step").cast("int")).alias("period"), F.lit("forecast").alias("type"),
        none.alias("actual"), "forecast", "lower_95", "upper_95")
    both = past.unionByName(ahead)
    numbers = ["actual", "forecast", "lower_95", "upper_95"]
    return both.select(
        SERIES, "period", F.date_format("period", "yyyy-MM").alias("period_label"), "type",
        *[F.round(c, 2).alias(c) for c in numbers], F.round(F.coalesce("actual", "forecast"), 2).alias("value"))
