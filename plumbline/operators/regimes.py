"""Volatility regimes in hindsight and in real time, and where the two disagree. Series are (series, idx, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.growing import expanding_quantiles
from plumbline.functions.running import exact_quantiles


def _order():
    return Window.partitionBy("series").orderBy("idx")


def label_by_quantile(value: Column, low: Column, high: Column) -> Column:
    """2 from ``high`` up (also if both hold), 0 to ``low``, 1 between."""
    return F.when(value >= high, 2).when(value <= low, 0).otherwise(1)


def hindsight_labels(series: DataFrame, *, lower: float = 0.33, upper: float = 0.8) -> DataFrame:
    """``series`` with label, from quantiles of the whole series."""
    cuts = exact_quantiles(series, "value", [lower, upper], "_cuts", groups=("series",)).withColumnRenamed("series", "_s")
    labelled = series.join(cuts, F.col("series").eqNullSafe(F.col("_s")))
    return labelled.withColumn("label", label_by_quantile(F.col("value"), F.get("_cuts", F.lit(0)), F.get("_cuts", F.lit(1)))).drop("_cuts", "_s")


def realtime_labels(series: DataFrame, *, lower: float = 0.33, upper: float = 0.8, warmup: int = 500) -> DataFrame:
    """(series, idx, value, label) from quantiles of earlier values alone; -1 for the first ``warmup`` rows.

    Quantiles of the growing past are found by wavelet descent, also over many tasks for one long series.
    Rows without a value are left out.
    """
    found = expanding_quantiles(series, [lower, upper])
    labels = label_by_quantile(F.col("value"), F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1)))
    return found.select("series", F.col("idx").cast("int").alias("idx"), "value", F.when(F.col("past") < max(warmup, 1), -1).otherwise(labels).cast("int").alias("label"))


def _pairs(labels: DataFrame) -> DataFrame:
    return labels.withColumn("next", F.lead("label").over(_order())).where("label >= 0 and next >= 0")


def transition_matrix(labels: DataFrame, *, states: int = 3) -> DataFrame:
    """(state, next, p) for all pairs of states; rows of states without a successor are 0."""
    counts = _pairs(labels).groupBy(F.col("label").alias("state"), "next").agg(F.count("*").alias("n"))
    spark = labels.sparkSession
    grid = spark.range(states * states).select((F.col("id") / states).cast("int").alias("state"), (F.col("id") % states).cast("int").alias("next"))
    joined = grid.join(counts, ["state", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("state"))
    return joined.select("state", "next", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("p"))


def persistence(labels: DataFrame) -> DataFrame:
    """One row (persistence): the share of valid neighbours with equal labels."""
    return _pairs(labels).agg(F.avg((F.col("label") == F.col("next")).cast("double")).alias("persistence"))


def runs(labels: DataFrame) -> DataFrame:
    """(series, regime, start, length): rows of negative label do not end a run, and the last reaches the end."""
    ends = labels.groupBy("series").agg((F.max("idx") + 1).alias("end"))
    valid = labels.where("label >= 0").withColumn("before", F.lag("label").over(_order())).where("before is null or before <> label")
    return valid.withColumn("next", F.lead("idx").over(_order())).join(ends, "series").select("series", F.col("label").alias("regime"), F.col("idx").alias("start"), (F.coalesce("next", "end") - F.col("idx")).alias("length"))


def compare(hindsight: DataFrame, realtime: DataFrame, *, window: int = 10) -> DataFrame:
    """One row: days compared, disagreeing, and both near turns of the hindsight labels."""
    h = hindsight.select("series", "idx", F.col("label").alias("h"))
    h = h.withColumn("turn", (F.coalesce(F.col("h") != F.lag("h").over(_order()), F.lit(False))).cast("int"))
    h = h.withColumn("near", F.max("turn").over(_order().rowsBetween(-window, window)))
    both = h.join(realtime.select("series", "idx", F.col("label").alias("r")), ["series", "idx"]).where("r >= 0")
    differ = (F.col("h") != F.col("r")).cast("int")
    sums = both.agg(F.count("*").alias("days_compared"), F.sum(differ).alias("days_disagreeing"), F.sum(differ * F.col("near")).alias("at_turning_points"), F.sum("near").cast("long").alias("turning_point_days"))
    rate, near = F.col("days_disagreeing") / F.col("days_compared"), F.when(F.col("turning_point_days") > 0, F.col("at_turning_points") / F.col("turning_point_days")).otherwise(0.0)
    return sums.select("*", rate.alias("rate"), near.alias("rate_near"), F.when(rate > 0, near / rate).otherwise(0.0).alias("concentration"))


def realised_volatility(returns: DataFrame, *, window: int = 21, periods: int = 252) -> DataFrame:
    """``returns`` with volatility: the annualised deviation of a full trailing window."""
    w = _order().rowsBetween(-(window - 1), 0)
    return returns.withColumn("volatility", F.when(F.count("ret").over(w) == window, F.stddev_samp("ret").over(w) * math.sqrt(periods)))


def detection_lag(hindsight: DataFrame, realtime: DataFrame, *, start: int = 500, cap: int = 120) -> DataFrame:
    """(series, start, lag): rows until the real-time label follows a stressed run, ``cap`` at most."""
    stressed = runs(hindsight).where((F.col("regime") == 2) & (F.col("start") >= start)).select("series", "start")
    seen = realtime.where("label = 2").select("series", F.col("idx").alias("at"))
    joined = stressed.join(seen, (stressed.series == seen.series) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + cap), "left").select(stressed.series, "start", "at")
    return joined.groupBy("series", "start").agg(F.coalesce(F.min(F.col("at") - F.col("start")), F.lit(cap)).alias("lag"))
