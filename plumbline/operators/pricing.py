"""Insurance pricing: banded factors, GLMs for frequency, severity and pure premium, and their tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles, running_totals
from plumbline.session import checkpointed

#: Exposure edges of the credibility table. Fixed values.
EXPOSURE_EDGES = [0.0, 0.05, 0.15, 0.35, 0.6, 0.85, 1.0]


def band(value: Column, edges: list[float], prefix: str) -> Column:
    """Right-closed bands (the first also left-closed) named prefix(lo+1)-hi; null outside."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), f"{prefix}{edges[0] + 1}-{edges[1]}")
    for lo, hi in zip(edges[1:], edges[2:], strict=False):
        out = out.when((value > lo) & (value <= hi), f"{prefix}{lo + 1}-{hi}")
    return out


def quantile_band(rows: DataFrame, column: str, bins: int, prefix: str, out: str) -> DataFrame:
    """``rows`` with right-closed quantile bands prefix1..prefixN."""
    cuts = exact_quantiles(rows, column, [k / bins for k in range(1, bins)], "_cuts")
    return rows.crossJoin(F.broadcast(cuts)).withColumn(out, F.concat(F.lit(prefix), (F.size(F.filter("_cuts", lambda c: c < F.col(column))) + 1).cast("string"))).drop("_cuts")


def prepare(policies: DataFrame) -> DataFrame:
    """Policies on risk, with balance bands and nation quintiles; rows without a band go."""
    rows = policies.where("exposure > 0").withColumn("balance_band", band(F.col("balance"), [-1000, 0, 2500, 5000, 7500, 10000], "bal"))
    return quantile_band(rows, "nation", 5, "nat", "nation_band").dropna(subset=["balance_band", "nation_band"])


@dataclass(frozen=True)
class Design:
    """Dummy columns of each factor's levels but the first, taken from the training rows."""

    columns: list[tuple[str, str]]

    @classmethod
    def of(cls, train: DataFrame, factors: list[str]) -> Design:
        levels = train.agg(*(F.sort_array(F.collect_set(f)).alias(f) for f in factors)).first()  # a few levels a factor
        return cls([(f, level) for f in factors for level in levels[f][1:]])

    def apply(self, rows: DataFrame) -> DataFrame:
        for k, (factor, level) in enumerate(self.columns):
            rows = rows.withColumn(f"_d{k}", (F.col(factor) == level).cast("double"))
        return VectorAssembler(inputCols=[f"_d{k}" for k in range(len(self.columns))], outputCol="features").transform(rows)

    @property
    def names(self) -> list[str]:
        return ["intercept", *(f"{f}={level}" for f, level in self.columns)]


@dataclass(frozen=True)
class Model:
    name: str
    design: Design
    coefficients: list[float]
    fitted: object

    def relativities(self, spark) -> DataFrame:
        import math

        return spark.createDataFrame([(self.name, n, c, math.exp(c)) for n, c in zip(self.design.names, self.coefficients, strict=True)], "model string, term string, coefficient double, relativity double")

    def predict(self, rows: DataFrame, out: str = "predicted", per_exposure: bool = True) -> DataFrame:
        """``rows`` with exp(x b), times the exposure if the model is of a rate."""
        designed = self.design.apply(rows)
        total = F.lit(self.coefficients[0])
        for k, c in enumerate(self.coefficients[1:]):
            total = total + F.col(f"_d{k}") * c
        value = F.exp(total) * (F.col("exposure") if per_exposure else 1.0)
        return designed.withColumn(out, value).drop("features", *(f"_d{k}" for k in range(len(self.design.columns))))


def _fit(rows: DataFrame, factors: list[str], name: str, **options) -> Model:
    """The rows are written once, narrow: every reweighting reads them, and would make them anew."""
    rows = checkpointed(rows.select(*factors, *(options[c] for c in ("labelCol", "weightCol", "offsetCol") if c in options)))
    design = Design.of(rows, factors)
    glm = GeneralizedLinearRegression(featuresCol="features", maxIter=50, tol=1e-10, **options).fit(design.apply(rows))
    return Model(name, design, [glm.intercept, *glm.coefficients.toArray().tolist()], glm)


def fit_frequency(policies: DataFrame, factors: list[str], *, use_offset: bool = True) -> Model:
    """Poisson, log link; without the offset of log exposure it is the deliberately wrong model."""
    rows = policies.withColumn("log_exposure", F.log("exposure"))
    return _fit(rows, factors, "frequency" if use_offset else "frequency without offset", family="poisson", link="log", labelCol="claims", **({"offsetCol": "log_exposure"} if use_offset else {}))


def fit_severity(policies: DataFrame, factors: list[str]) -> Model:
    """Gamma, log link, of the mean claim of policies with a claim."""
    rows = policies.where("claims > 0 and amount > 0").withColumn("mean_claim", F.col("amount") / F.col("claims"))
    return _fit(rows, factors, "severity", family="gamma", link="log", labelCol="mean_claim", weightCol="claims")


def fit_tweedie(policies: DataFrame, factors: list[str], *, power: float = 1.5) -> Model:
    """Tweedie, log link, of the loss per exposure-year, weighted by exposure."""
    rows = policies.withColumn("loss_rate", F.col("amount") / F.col("exposure"))
    return _fit(rows, factors, "tweedie", family="tweedie", variancePower=power, linkPower=0.0, labelCol="loss_rate", weightCol="exposure")


def lift_table(rows: DataFrame, *, order: str = "predicted", bins: int = 10) -> DataFrame:
    """(decile, policies, exposure_years, predicted, actual, ratio) by predicted risk; edges at floor(n b / bins).

    Rows of (id, predicted, actual, exposure); the order is by prediction, then id.
    """
    total = rows.agg(F.count("*").alias("_n"))
    each = rows.groupBy(F.col(order).alias("_p")).agg(F.count("*").alias("_k"))
    run = running_totals(each, "_p", {"_upto": F.col("_k")}).crossJoin(F.broadcast(total))

    def decile(at: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda b: F.floor(F.col("_n") * b / bins) <= at)) + 1

    span = run.select("_p", "_n", (F.col("_upto") - F.col("_k")).alias("_from"), decile(F.col("_upto") - F.col("_k")).alias("_low"), decile(F.col("_upto") - 1).alias("_high"))
    joined = rows.join(span, F.col(order).eqNullSafe(F.col("_p")))
    # Only predictions that an edge cuts (fewer than bins) need their rows in the order of ids.
    split = running_totals(joined.where("_low < _high").withColumn("_one", F.lit(1)), "id", {"_place": F.col("_one")}, groups=("_p",))
    binned = joined.where("_low = _high").withColumn("decile", F.col("_low")).select("decile", "predicted", "actual", "exposure")
    binned = binned.unionByName(split.withColumn("decile", decile(F.col("_from") + F.col("_place") - 1)).select("decile", "predicted", "actual", "exposure"))
    cells = binned.groupBy("decile").agg(F.count("*").alias("policies"), F.sum("exposure").alias("exposure_years"), (F.sum("predicted") / F.sum("exposure")).alias("predicted"), (F.sum("actual") / F.sum("exposure")).alias("actual"))
    return cells.withColumn("ratio", F.when(F.col("predicted") != 0, F.col("actual") / F.col("predicted")))


def priced_gini(rows: DataFrame) -> DataFrame:
    """One row (gini): 1 - 2 times the area of loss over exposure in the order of the predicted rate.

    The first trapezoid starts at the first row (no origin); rows of equal rates are one step.
    """
    rate = F.round(F.col("predicted") / F.greatest("exposure", F.lit(1e-9)), 12)  # a factor's rate, without noise of the division
    each = rows.groupBy(rate.alias("rate")).agg(F.sum("actual").alias("l"), F.sum("exposure").alias("e"))
    total = each.agg(F.greatest(F.sum("l"), F.lit(1e-12)).alias("tl"), F.greatest(F.sum("e"), F.lit(1e-12)).alias("te"), F.min("rate").alias("first"))
    run = running_totals(each, "rate", {"cl": F.col("l"), "ce": F.col("e")}).crossJoin(F.broadcast(total))
    step = F.when(F.col("rate") == F.col("first"), 0.0).otherwise(F.col("e") / F.col("te") * (2 * F.col("cl") - F.col("l")) / F.col("tl") / 2)
    return run.agg((1 - 2 * F.sum(step)).alias("gini"))


def credible_bands(rows: DataFrame, *, edges: list[float] | None = None, least_years: float = 500.0) -> DataFrame:
    """(band, policies, exposure_years, claims, rates, share_claiming, credible) by right-closed exposure band."""
    edges = edges or EXPOSURE_EDGES
    k = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[1:-1])), lambda e: e < F.col("exposure")))
    cells = rows.where((F.col("exposure") >= edges[0]) & (F.col("exposure") <= edges[-1])).groupBy(k.alias("band")).agg(
        F.count("*").alias("policies"), F.sum("exposure").alias("exposure_years"), F.sum("actual").alias("claims"), F.sum("predicted").alias("predicted_claims"), F.avg((F.col("actual") > 0).cast("double")).alias("share_claiming"),
    )
    return cells.withColumn("observed_rate", F.col("claims") / F.col("exposure_years")).withColumn("predicted_rate", F.col("predicted_claims") / F.col("exposure_years")).withColumn("credible", F.col("exposure_years") >= least_years)


def cap_losses(rows: DataFrame, column: str, *, quantile: float = 0.995) -> DataFrame:
    """``rows`` with positive losses capped at their quantile."""
    cap = exact_quantiles(rows.where(F.col(column) > 0), column, [quantile]).select(F.get("cuts", F.lit(0)).alias("_cap"))
    return rows.crossJoin(F.broadcast(cap)).withColumn(column, F.least(F.col(column), F.coalesce("_cap", F.col(column)))).drop("_cap")
