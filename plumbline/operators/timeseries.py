"""Stationarity tests, spurious regressions, and forecasters that are refitted for each fold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import normal_cdf
from plumbline.operators import plugins
from plumbline.operators.overlap import ols
from plumbline.operators.statespace import Arima, Holt, arma_filter
from plumbline.session import ship

#: MacKinnon's (1994) response surface for the Dickey-Fuller test with a constant, one series. Fixed values.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
#: Critical values of the KPSS test around a level at 10, 5, 2.5 and 1 per cent (Kwiatkowski et al. 1992). Fixed values.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    sse = float(rest @ rest)
    variance = sse / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * variance), sse


def adf(values: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the augmented Dickey-Fuller test with a constant, lags chosen by AIC."""
    y = np.asarray(values, float)
    most = min(int(math.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
    dy = np.diff(y)

    def design(lags: int, drop: int):
        rows = np.arange(drop, len(dy))
        return np.column_stack([y[rows], *(dy[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))]), dy[rows]

    def aic(lags: int) -> float:
        x, t = design(lags, most)
        n = len(t)
        return n * math.log(max(_least_squares(x, t)[2] / n, 1e-300)) + 2 * x.shape[1]

    best = min(range(most + 1), key=aic)
    beta, errors, _ = _least_squares(*design(best, best))
    stat = float(beta[0] / errors[0])
    if stat > ADF_MAX:
        return stat, 1.0
    if stat < ADF_MIN:
        return stat, 0.0
    powers = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    return stat, normal_cdf(sum(c * stat**k for k, c in enumerate(powers)))


def kpss(values: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the KPSS test around a level; the bandwidth follows Hobijn et al., p stays in 0.01..0.1."""
    y = np.asarray(values, float)
    e, n = y - y.mean(), len(y)
    lags = int(n ** (2 / 9))
    s0 = float(e @ e) / n
    s1 = 0.0
    for k in range(1, lags + 1):
        product = float(e[k:] @ e[:-k]) / (n / 2)
        s0, s1 = s0 + product, s1 + k * product
    ratio = s1 / s0 if s0 else 0.0
    width = min(int(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = float(e @ e) / n + 2 / n * sum((1 - k / (width + 1)) * float(e[k:] @ e[:-k]) for k in range(1, width + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * long_run))
    xs, ps = zip(*KPSS_CRITICAL, strict=True)
    return stat, float(np.interp(stat, xs, ps))


def stationarity(series: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """(series, adf_p, kpss_p, adf_says, kpss_says, verdict) of each series (series, idx, value); series run in parallel."""
    ship(series.sparkSession)

    def judge(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for name, idx, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(name, []).append((idx, value))
        rows = []
        for name, pairs in held.items():
            values = np.array([v for _, v in sorted(pairs)])
            a, k = adf(values)[1], kpss(values)[1]
            one, two = a < alpha, k >= alpha
            rows.append((name, a, k, one, two, "undecided" if one != two else "stationary" if one else "non-stationary"))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("series", "adf_p", "kpss_p", "adf_says", "kpss_says", "verdict"), map(list, zip(*rows, strict=True)), strict=True)))

    return series.select("series", "idx", "value").repartition("series").mapInArrow(judge, "series string, adf_p double, kpss_p double, adf_says boolean, kpss_says boolean, verdict string")


def spurious_regression(spark, n: int, *, trials: int, seed: int = 0) -> DataFrame:
    """(trial, kind, slope, t, significant, r2) of unrelated random walks, in levels and in differences."""
    steps = spark.range(trials * n).select((F.col("id") / n).cast("int").alias("trial"), (F.col("id") % n).cast("int").alias("idx"), F.randn(seed).alias("dx"), F.randn(seed + 1).alias("dy"))
    w = Window.partitionBy("trial").orderBy("idx")
    walks = steps.select("trial", "dx", "dy", F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"))
    both = walks.select("trial", F.explode(F.array(F.struct(F.lit("levels").alias("kind"), F.col("x"), F.col("y")), F.struct(F.lit("differences").alias("kind"), F.col("dx").alias("x"), F.col("dy").alias("y")))).alias("e")).select("trial", "e.*")
    fits = both.groupBy("trial", "kind").agg(*ols())
    t = F.col("slope") / F.col("se")
    return fits.select("trial", "kind", "slope", t.alias("t"), (F.abs(t) > 1.96).alias("significant"), "r2")


def innovations(series: DataFrame, phi: list[float], theta: list[float]) -> DataFrame:
    """(series, idx, innovation, variance): the exact filter of an ARMA process over each series (series, idx, value).

    A series is filtered in order by one task; ``variance`` is that of the innovation over that of the noise.
    """
    ship(series.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        e, f, _ = arma_filter(table["value"].to_numpy(), np.array(phi), np.array(theta))
        return pa.table([table["series"], table["idx"], pa.array(e), pa.array(f)], names=["series", "idx", "innovation", "variance"])

    rows = series.select(F.col("series").cast("string").alias("series"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("series").applyInArrow(run, "series string, idx long, innovation double, variance double")


def fold_forecasts(series: DataFrame, origins: list[int], horizon: int, *, orders: tuple[tuple[int, int, int], ...] = ((1, 1, 1), (2, 1, 2))) -> DataFrame:
    """(model, origin, last, i, actual, forecast) of ARIMA and Holt, refitted at each origin; folds run in parallel."""
    return plugins.fold_forecasts(series, origins, horizon, [*(Arima(o) for o in orders), Holt()])
