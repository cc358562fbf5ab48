"""Rolling-origin evaluation of forecasts. Series are (idx, value); all models see the same folds.

Baselines are windows over the series, read at each origin; folds and horizons are rows of a join, so one
plan scores every model at every origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.plugins import Forecaster
from plumbline.operators.plugins import fold_forecasts as plugin_forecasts


def _order():
    return Window.orderBy("idx")


def folds(series: DataFrame, origins: list[int], horizon: int, *, embargo: int = 0) -> DataFrame:
    """(origin, last, i, actual): step i of each origin; ``last`` is the last row of training."""
    picks = series.sparkSession.createDataFrame([(o, max(o - embargo, 1) - 1) for o in origins], "origin int, last int")
    steps = picks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    return steps.join(series.select((F.col("idx")).alias("at"), F.col("value").alias("actual")), F.col("at") == F.col("origin") + F.col("i")).drop("at")


def _value_at(frame: DataFrame, series: DataFrame, at: Column, name: str, value: str = "value") -> DataFrame:
    return frame.withColumn("_at", at).join(series.select(F.col("idx").alias("_at"), F.col(value).alias(name)), "_at", "left").drop("_at")


def seasonal_naive(steps: DataFrame, series: DataFrame, *, season: int = 7) -> DataFrame:
    """The value one season before; a history shorter than a season repeats its last value."""
    at = F.when(F.col("last") + 1 < season, F.col("last")).otherwise(F.col("last") + 1 - season + F.col("i") % season)
    return _value_at(steps, series, at, "forecast")


def drifting_mean(steps: DataFrame, series: DataFrame, *, window: int = 28) -> DataFrame:
    """The mean of the last ``window`` values."""
    means = series.withColumn("m", F.avg("value").over(_order().rowsBetween(-(window - 1), 0)))
    return _value_at(steps, means, F.col("last"), "forecast", "m")


def seasonal_mean(steps: DataFrame, series: DataFrame, *, season: int = 7, lookback: int = 8) -> DataFrame:
    """The mean of the last ``lookback`` values of the step's phase."""
    phase = Window.partitionBy(F.col("idx") % season).orderBy("idx").rowsBetween(-(lookback - 1), 0)
    means = series.withColumn("m", F.avg("value").over(phase))
    # The last row of training with the phase of step i.
    n = F.col("last") + 1
    back = F.pmod(F.col("last") - (n + F.col("i")), F.lit(season))
    return _value_at(steps, means, F.col("last") - back, "forecast", "m")


def random_walk(steps: DataFrame, series: DataFrame) -> DataFrame:
    return _value_at(steps, series, F.col("last"), "forecast")


def drift(steps: DataFrame, series: DataFrame) -> DataFrame:
    """The last value and the mean step so far, for each step ahead."""
    slopes = series.withColumn("first", F.first("value").over(_order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("slope", F.when(F.col("idx") > 0, (F.col("value") - F.col("first")) / F.col("idx")).otherwise(0.0))
    both = _value_at(_value_at(steps, slopes, F.col("last"), "_slope", "slope"), series, F.col("last"), "_v")
    return both.withColumn("forecast", F.col("_v") + F.col("_slope") * (F.col("i") + 1)).drop("_slope", "_v")


def trailing_mean(steps: DataFrame, series: DataFrame, *, window: int = 24) -> DataFrame:
    return drifting_mean(steps, series, window=window)


def scales(series: DataFrame, season: int) -> DataFrame:
    """(last, scale): the mean absolute seasonal step of the training rows up to ``last`` (null without one)."""
    step = F.abs(F.col("value") - F.lag("value", season).over(_order()))
    mean = series.withColumn("d", step).select(F.col("idx").alias("last"), F.avg("d").over(_order().rowsBetween(Window.unboundedPreceding, 0)).alias("scale"))
    return mean.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")))


def fold_scores(forecasts: DataFrame, scale: DataFrame) -> DataFrame:
    """(model, origin, mase, mape, bias) of rows (model, origin, last, actual, forecast)."""
    gap = F.col("forecast") - F.col("actual")
    per = forecasts.groupBy("model", "origin", "last").agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(F.when(F.col("actual") != 0, F.abs(gap / F.col("actual")))).alias("mape"), F.avg(gap).alias("bias"),
    )
    return per.join(scale, "last", "left").select("model", "origin", (F.col("mae") / F.col("scale")).alias("mase"), "mape", "bias")


MODELS = {"seasonal_naive": seasonal_naive, "drifting_mean": drifting_mean, "seasonal_mean": seasonal_mean, "random_walk": random_walk, "drift": drift, "trailing_mean": trailing_mean}


def evaluate(series: DataFrame, origins: list[int], *, horizon: int = 7, season: int = 7, embargo: int = 0, models: tuple[str, ...] = ("seasonal_naive", "drifting_mean", "seasonal_mean"), own: tuple[Forecaster, ...] = ()) -> DataFrame:
    """(model, mase, mape, bias, folds): means over folds, undefined folds skipped.

    ``own`` are a user's forecasters; they see what the named models see (with an embargo, less of the past).
    """
    steps = folds(series, origins, horizon, embargo=embargo)
    out = None
    for name in models:
        one = MODELS[name](steps, series).select(F.lit(name).alias("model"), "origin", "last", "actual", "forecast")
        out = one if out is None else out.unionByName(one)
    if own:
        cut = [max(o - embargo, 1) for o in origins]
        ahead = plugin_forecasts(series, cut, horizon + embargo, list(own)).withColumnRenamed("origin", "_cut")
        shift = dict(zip(cut, origins, strict=True))
        step = F.coalesce(*(F.when(F.col("_cut") == c, F.lit(o)) for c, o in shift.items()))
        mine = ahead.withColumn("origin", step).where(F.col("_cut") + F.col("i") >= F.col("origin")).select("model", "origin", "last", "actual", "forecast")
        out = mine if out is None else out.unionByName(mine)
    per = fold_scores(out, scales(series, season))
    return per.groupBy("model").agg(F.avg("mase").alias("mase"), F.avg("mape").alias("mape"), F.avg("bias").alias("bias"), F.count("*").alias("folds"))


def evenly_spaced(minimum: int, n: int, horizon: int, count: int) -> list[int]:
    """Origins of a backtest with ``count`` folds from ``minimum`` to the last possible, rounded down."""
    return [int(minimum + (n - horizon - minimum) * k / (count - 1)) for k in range(count)] if count > 1 else [minimum]
