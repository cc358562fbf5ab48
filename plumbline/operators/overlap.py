"""Regressions on overlapping windows: least squares, Newey-West errors and disjoint samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tails import student_two_sided


def forward_return(series: DataFrame, horizon: int, *, per_year: int = 12) -> DataFrame:
    """``series`` with forward: the annualised return over the next ``horizon`` rows (null at the end)."""
    ahead = F.lead("value", horizon).over(Window.partitionBy("series").orderBy("idx"))
    return series.withColumn("forward", F.pow(ahead / F.col("value"), per_year / horizon) - 1)


def effective_sample_size(n: int, horizon: int) -> float:
    return n / horizon


def ols(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates slope, intercept, se (n - 2 degrees), r2 and n of y on x."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    rest = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    return [
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when((n > 2) & (sxx > 0), F.sqrt(rest / (n - 2) / sxx)).alias("se"),
        F.when((sxx > 0) & (syy > 0), sxy * sxy / (sxx * syy)).otherwise(0.0).alias("r2"), n.alias("n"),
    ]


def newey_west(rows: DataFrame, *, lags: int) -> DataFrame:
    """One row (slope, se) of y on x by idx with Bartlett-weighted autocovariances, without a degrees correction.

    The lagged products are one equi-join of the scores with themselves at each lag.
    """
    fit = rows.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    u = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    scores = rows.crossJoin(F.broadcast(fit.select("a", "b"))).select("idx", u.alias("s0"), (u * F.col("x")).alias("s1"))
    earlier = scores.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "idx", F.col("s0").alias("p0"), F.col("s1").alias("p1")).withColumn("idx", F.col("idx") + F.col("lag"))
    weight = F.when(F.col("lag") == 0, 0.5).otherwise(1 - F.col("lag") / (lags + 1.0))
    meat = scores.join(earlier, "idx").agg(
        F.sum(2 * weight * F.col("s0") * F.col("p0")).alias("m00"), F.sum(weight * (F.col("s0") * F.col("p1") + F.col("s1") * F.col("p0"))).alias("m01"), F.sum(2 * weight * F.col("s1") * F.col("p1")).alias("m11"),
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    variance = (F.col("sx") * F.col("sx") * F.col("m00") - 2 * F.col("n") * F.col("sx") * F.col("m01") + F.col("n") * F.col("n") * F.col("m11")) / (det * det)
    return fit.crossJoin(meat).select(F.col("b").alias("slope"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"))


def disjoint(rows: DataFrame, horizon: int, *, offset: int = 0) -> DataFrame:
    """Every ``horizon``-th row from ``offset`` on."""
    return rows.where((F.col("idx") >= offset) & ((F.col("idx") - offset) % horizon == 0))


def offset_sweep(rows: DataFrame, horizon: int, *, least: int = 8) -> DataFrame:
    """(offset, slope, se, ...) of the disjoint sample at every offset, in one aggregation."""
    return rows.groupBy((F.col("idx") % horizon).alias("offset")).agg(*ols()).where(F.col("n") >= least)


def judged(estimates: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """``estimates`` (slope, se, n_independent, ...) with t, p and significant; a missing or zero error gives t = 0.

    Degrees of freedom are those of the independent observations, 1 at least.
    """
    t = F.when(F.col("se") > 0, F.col("slope") / F.col("se")).otherwise(0.0)
    judged = estimates.withColumn("t", t).withColumn("p", student_two_sided(F.col("t"), F.greatest(F.col("n_independent") - 2, F.lit(1.0))))
    return judged.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def overlapping_verdict(rows: DataFrame, horizon: int) -> DataFrame:
    """(method, slope, se, n, n_independent, t, p, significant) of y on x: rows as if independent, and by their effective number."""
    fit = rows.agg(*ols()).select("slope", "se", "n")
    n, fair = F.col("n").cast("double"), F.col("n") / horizon
    plain = fit.withColumn("method", F.lit("ols")).withColumn("n_independent", n)
    wide = fit.withColumn("method", F.lit("effective")).withColumn("se", F.col("se") * F.sqrt(n / fair)).withColumn("n_independent", fair)
    return judged(plain.unionByName(wide))


def slopes_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, slope, se, n, n_independent, t, p, significant) of y on x in each group, in one aggregation; groups without an error are left out."""
    each = rows.groupBy(key).agg(*ols()).where(F.col("se").isNotNull())
    return judged(each.select(key, "slope", "se", "n", F.col("n").cast("double").alias("n_independent")))
