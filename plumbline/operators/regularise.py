"""Stability of what penalised regressions select. Rows are (id, y, columns...)."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.batched import Fit, Model, areas, fit_all, fit_narrowed, narrowed

#: Share of the penalty that is l1, by name.
SHARES = {"l1": 1.0, "l2": 0.0, "none": 0.0}


def penalty_model(penalty: str, c: float, l1_ratio: float = 0.5) -> Model:
    return Model(f"{penalty}/{c:g}", math.inf if penalty == "none" else c, SHARES.get(penalty, l1_ratio))


def fit_penalised(train: DataFrame, test: DataFrame, columns: list[str], models: list[Model]) -> tuple[DataFrame, list[Fit]]:
    """((model, train_auc, test_auc, selected), fits) of all models at once; selected: weights beyond 1e-6."""
    draws = any(m.replicate is not None for m in models)
    own, other = narrowed(train, columns, draws=draws), narrowed(test, columns, draws=draws)
    fits = fit_narrowed(own, columns, models)
    picked = train.sparkSession.createDataFrame([(f.model.name, int(f.selected.sum())) for f in fits], "model string, selected int")
    judged = [areas(rows, columns, fits, name) for rows, name in ((own, "train_auc"), (other, "test_auc"))]
    return picked.join(judged[0], "model").join(judged[1], "model").select("model", "train_auc", "test_auc", "selected"), fits


def regularisation_path(train: DataFrame, test: DataFrame, columns: list[str], *, strengths: list[float], penalty: str = "l1") -> DataFrame:
    """(c, column, coefficient, selected, train_auc, test_auc) at each strength; all strengths are one batch of fits."""
    models = [penalty_model(penalty, c) for c in strengths]
    judged, fits = fit_penalised(train, test, columns, models)
    rows = [(f.model.name, float(c), name, float(b)) for c, f in zip(strengths, fits, strict=True) for name, b in zip(columns, f.beta, strict=False)]
    return train.sparkSession.createDataFrame(rows, "model string, c double, column string, coefficient double").join(judged, "model").drop("model")


def bootstrap_fits(rows: DataFrame, columns: list[str], *, c: float, replicates: int, seed: int = 0) -> list[list[float]]:
    """Coefficients of l1 fits on Poisson bootstrap weights drawn from the id; all replicates are one batch of fits."""
    fits = fit_all(rows, columns, [Model(str(r), c, 1.0, 100_000 * seed + r) for r in range(replicates)])
    return [f.beta[:-1].tolist() for f in fits]


def selection_frequency(spark, fits: list[list[float]], columns: list[str]) -> DataFrame:
    """(column, frequency, sign_consistency, coin_flip): a coin flip is selected in a quarter to three quarters of the fits."""
    out = []
    for k, name in enumerate(columns):
        own = [f[k] for f in fits if abs(f[k]) > 1e-6]
        share = len(own) / len(fits)
        sign = max(sum(b > 0 for b in own), sum(b < 0 for b in own)) / len(own) if own else 0.0
        out.append((name, share, sign, abs(share - 0.5) < 0.25))
    return spark.createDataFrame(out, "column string, frequency double, sign_consistency double, coin_flip boolean")


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def pairwise_stability(spark, fits: list[list[float]]) -> DataFrame:
    """(a, b, jaccard) of the selections of each two fits."""
    picked = [{k for k, b in enumerate(f) if abs(b) > 1e-6} for f in fits]
    return spark.createDataFrame([(a, b, jaccard(picked[a], picked[b])) for a, b in combinations(range(len(picked)), 2)], "a int, b int, jaccard double")


def engineer(rows: DataFrame, *, air: str, process: str, speed: str, torque: str, wear: str, grade: str) -> DataFrame:
    """``rows`` as (id, y, features): the features that an engineer would build of a machine's readings, near copies of each other.

    Temperatures in kelvin, speed in turns a minute, torque in newton metres, wear in minutes, grade L, M or H; a
    null reading gives null features.
    """
    a, p, s, t, w = (F.col(c).cast("double") for c in (air, process, speed, torque, wear))
    power = t * s * (2 * math.pi / 60)
    features = {
        "air_temp": a, "process_temp": p, "temp_difference": p - a, "temp_ratio": p / a, "speed": s, "torque": t, "power": power, "log_power": F.log1p(power), "tool_wear": w,
        "wear_x_torque": w * t, "wear_squared": w * w, "torque_per_rpm": t / s, "is_low_quality": (F.col(grade) == "L").cast("double"), "is_high_quality": (F.col(grade) == "H").cast("double"),
    }
    return rows.select("id", "y", *(e.alias(n) for n, e in features.items()))


def correlated_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = rows.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("e")).select("e.*")
