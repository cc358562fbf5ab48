"""Calibrators of scores, fitted on one split and judged on another. Rows are (id, y, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.session import checkpointed


def logit(score: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), score))
    return F.log(p / (1 - p))


def _assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def _weights(weight: str | None) -> list[Column]:
    return [F.col(weight).cast("double").alias("weight")] if weight else []


def _options(weight: str | None) -> dict[str, str]:
    return {"weightCol": "weight"} if weight else {}


class Uncalibrated:
    name = "uncalibrated"

    def fit(self, rows: DataFrame, weight: str | None = None) -> Uncalibrated:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows


class Platt:
    """An unpenalised logistic curve over the log odds."""

    name = "platt"

    def fit(self, rows: DataFrame, weight: str | None = None) -> Platt:
        data = _assemble(rows.select(F.col("y").cast("double").alias("label"), logit(F.col("score")).alias("z"), *_weights(weight)), ["z"])
        model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-10, **_options(weight)).fit(data)
        self.a, self.b = float(model.coefficients[0]), float(model.intercept)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", 1 / (1 + F.exp(-(logit(F.col("score")) * self.a + self.b))))


class Isotonic:
    """Pool-adjacent-violators, read linearly between knots and flat outside."""

    name = "isotonic"

    def fit(self, rows: DataFrame, weight: str | None = None) -> Isotonic:
        data = rows.select(F.col("y").cast("double").alias("label"), F.col("score").cast("double").alias("score"), *_weights(weight))
        self.model = IsotonicRegression(featuresCol="score", labelCol="label", **_options(weight)).fit(data)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows.withColumn("score", F.col("score").cast("double")))
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def report(calibrator, fit_rows: DataFrame, test_rows: DataFrame, *, bins: int = 12) -> DataFrame:
    """One row (method, auc, brier, ece, mce) on the test rows."""
    return reports([calibrator], fit_rows, test_rows, bins=bins)


def reports(calibrators: list, fit_rows: DataFrame, test_rows: DataFrame, *, bins: int = 12) -> DataFrame:
    """(method, auc, brier, ece, mce) of each calibrator on the test rows."""
    return reports_of_counts(calibrators, counted(fit_rows), counted(test_rows), bins=bins)


def counted(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, y, score, n): rows of equal label and score, counted once and written, as fits and figures all read them."""
    return checkpointed(rows.groupBy(*groups, "y", "score").agg(F.count("*").alias("n")))


def reports_of_counts(calibrators: list, fit_counts: DataFrame, test_counts: DataFrame, *, bins: int = 12) -> DataFrame:
    """``reports`` of counted rows (y, score, n). A calibrated score follows from the score alone, so all methods' figures come from one table of counts."""
    judged = [c.fit(fit_counts, "n").transform(test_counts).select(F.lit(c.name).alias("method"), "y", F.col("score").cast("double").alias("score"), "n") for c in calibrators]
    each = checkpointed(reduce(DataFrame.unionByName, judged).groupBy("method", "y", "score").agg(F.sum("n").alias("n")))
    off = F.pow(F.col("score") - F.col("y"), 2)
    brier = each.groupBy("method").agg((F.sum(off * F.col("n")) / F.sum(F.when(off.isNotNull(), F.col("n")))).alias("brier"))
    errors = M.calibration_errors(each, bins=bins, groups=("method",), weight="n")
    return M.auc(each, groups=("method",), weight="n").join(brier, "method").join(errors, "method").select("method", "auc", "brier", "ece", "mce")


def logistic_scores(train: DataFrame, test: DataFrame, columns: list[str], *, penalty: str = "l2", c: float = 1.0, l1_ratio: float = 0.5, weight: str | None = None):
    """(scored test rows (id, y, score), model): logistic regression of strength c, on columns as they are.

    The objective of strength c over n rows is the mean loss with a penalty of 1 / (c n).
    """
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, "none": 0.0}[penalty]
    n = train.count()
    regularisation = 0.0 if penalty == "none" else 1.0 / (c * n)
    options = {"weightCol": weight} if weight else {}
    model = LogisticRegression(labelCol="y", regParam=regularisation, elasticNetParam=mix, standardization=False, maxIter=200, tol=1e-8, **options).fit(_assemble(train, columns))
    scored = model.transform(_assemble(test, columns)).select("id", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    return scored, model


def standardise(train: DataFrame, rows: DataFrame, columns: list[str], *, sample: bool = False) -> DataFrame:
    """``rows`` with columns centred and scaled by the training rows' mean and (population) deviation, which are found once."""
    sd = F.stddev_samp if sample else F.stddev_pop
    figures = checkpointed(train.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(sd(c).alias(f"_s_{c}") for c in columns)))
    out = rows.crossJoin(F.broadcast(figures))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return out.drop(*(f"_m_{c}" for c in columns), *(f"_s_{c}" for c in columns))
