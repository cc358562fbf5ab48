"""Queries of the operators that fit models; they join the registry of ``queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles
from plumbline.operators import anomaly as AN
from plumbline.operators import calibration as CA
from plumbline.operators import clusters as CL
from plumbline.operators import forecast as FC
from plumbline.operators import metrics as M
from plumbline.operators import pricing as PR
from plumbline.operators import recommend as RE
from plumbline.operators import reduce as RD
from plumbline.operators import regularise as RG
from plumbline.operators import timeseries as TS
from plumbline.operators import trees as TR
from plumbline.operators.batched import Model, fit_all, moments
from plumbline.plans.queries import query
from plumbline.session import checkpointed
from plumbline.sources import views as V

# --- pricing

FACTORS = ["segment", "nation_band", "balance_band"]


def _policies(spark, d):
    """A row a customer, made of all orders and lines once for the quantiles, the fits and what is read from them."""
    return PR.prepare(checkpointed(V.policies(spark, d)))


def _by_segment(spark, d):
    """Policies priced at their segment's claim rate: the closed form of a Poisson model with one factor."""
    rows = V.policies(spark, d)
    rate = rows.groupBy("segment").agg((F.sum("claims") / F.sum("exposure")).alias("rate"))
    return rows.join(rate, "segment").select(F.col("policy").alias("id"), "exposure", F.col("claims").cast("double").alias("actual"), (F.col("rate") * F.col("exposure")).alias("predicted"))


@query
def policies(spark, d):
    return V.policies(spark, d)


@query
def pricing_bands(spark, d):
    return _policies(spark, d).groupBy("balance_band", "nation_band").agg(F.count("*").alias("policies"), F.sum("claims").alias("claims"))


@query
def frequency_relativities(spark, d):
    return PR.fit_frequency(_policies(spark, d), FACTORS).relativities(spark)


@query
def frequency_without_offset(spark, d):
    return PR.fit_frequency(_policies(spark, d), FACTORS, use_offset=False).relativities(spark)


@query
def frequency_by_segment(spark, d):
    """One factor: the relativities are the ratios of the segments' claim rates."""
    return PR.fit_frequency(V.policies(spark, d), ["segment"]).relativities(spark).select("term", F.round("relativity", 4).alias("relativity"))


@query
def severity_relativities(spark, d):
    return PR.fit_severity(_policies(spark, d), FACTORS).relativities(spark)


@query
def tweedie_relativities(spark, d):
    return PR.fit_tweedie(PR.cap_losses(_policies(spark, d), "amount"), FACTORS).relativities(spark)


@query
def glm_margins(spark, d):
    """(model, factor, level, total): what the fitted models of several factors add up to in each level.

    At the maximum likelihood a Poisson model gives each level its observed claims, and a gamma model of mean
    claims, weighted by claims, gives each level a sum of claims x observed / fitted equal to its claims.
    """
    rows = checkpointed(_policies(spark, d))
    claimed = rows.where("claims > 0 and amount > 0")
    often = PR.fit_frequency(rows, FACTORS).predict(rows).withColumn("part", F.col("predicted")).withColumn("model", F.lit("frequency"))
    much = PR.fit_severity(rows, FACTORS).predict(claimed, per_exposure=False).withColumn("part", F.col("amount") / F.col("predicted")).withColumn("model", F.lit("severity"))
    both = often.select("model", "part", *FACTORS).unionByName(much.select("model", "part", *FACTORS))
    levels = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in FACTORS)))
    return both.select("model", "part", levels.alias("l")).groupBy("model", "l.factor", "l.level").agg(F.round(F.sum("part"), 2).alias("total"))


@query
def pricing_lift_table(spark, d):
    return PR.lift_table(_by_segment(spark, d))


@query
def priced_gini(spark, d):
    return PR.priced_gini(_by_segment(spark, d))


@query
def poisson_deviance(spark, d):
    return M.poisson_deviance(_by_segment(spark, d), "predicted", "actual")


@query
def credible_bands(spark, d):
    return PR.credible_bands(_by_segment(spark, d), least_years=100.0)


@query
def large_loss_cap(spark, d):
    return PR.cap_losses(V.policies(spark, d), "amount").agg(F.max("amount").alias("cap"), F.sum("amount").alias("total"))


@query
def pure_premium(spark, d):
    """Frequency times severity against Tweedie: predicted and actual loss."""
    rows = _policies(spark, d)
    both = PR.fit_frequency(rows, FACTORS).predict(rows, "f")
    both = PR.fit_severity(rows, FACTORS).predict(both, "s", per_exposure=False)
    both = PR.fit_tweedie(rows, FACTORS).predict(both, "t")
    return both.agg(F.sum(F.col("f") * F.col("s")).alias("frequency_severity"), F.sum("t").alias("tweedie"), F.sum("amount").alias("actual"))


# --- classifiers and calibration

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, d):
    lines = V.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("double").alias("y"), *FEATURES, "l_shipdate")
    return lines.withColumn("part", F.pmod("id", F.lit(5)))


@query
def calibrators(spark, d):
    """AUC, Brier score and calibration errors of a logistic model before and after Platt and isotonic calibration.

    Three fifths are there to fit, a fifth to calibrate, a fifth to judge, standardised by the first.
    """
    lines = _lines(spark, d)
    rows = CA.standardise(lines.where("part < 3"), lines, FEATURES)
    scored, _ = CA.logistic_scores(rows.where("part < 3"), rows.where("part >= 3"), FEATURES)
    counts = CA.counted(scored.withColumn("part", F.pmod("id", F.lit(5))), "part")
    return CA.reports_of_counts([CA.Uncalibrated(), CA.Platt(), CA.Isotonic()], counts.where("part = 3"), counts.where("part = 4"))


def _areas_of_trees(rows, features):
    """(split, model, auc) of three classifiers on rows (id, label, features, part, late), judged by chance (a fifth) and in time (``late``).

    Trees are fitted and judged on counts of the rows by their bins; if there are too many for a task, by Spark on the rows.
    Rows that are judged are scored by all other models in one pass, and their distinct scores are counted once for all areas.
    """
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    splits = {"random": F.col("part") == 4, "time": F.col("late")}
    cells = TR.cells(rows, features, splits)
    few = cells.count() <= TR.CELLS
    models = {"bayes": NaiveBayes(modelType="gaussian")}
    if not few:
        models |= {"boosted": GBTClassifier(maxIter=250, maxDepth=3, seed=1), "forest": RandomForestClassifier(numTrees=250, maxDepth=4, seed=1)}
    scored, scores = data.where(reduce(Column.__or__, splits.values())), []
    for split, test in splits.items():
        for name, model in models.items():
            own = f"_{split}_{name}"
            fitted = model.fit(data.where(~test)).setFeaturesCol("features").setPredictionCol("").setRawPredictionCol("").setProbabilityCol(own)
            scored = fitted.transform(scored)
            score = F.when(test, F.get(vector_to_array(own), F.lit(1)))
            scores.append(F.struct(F.lit(split).alias("split"), F.lit(name).alias("model"), score.alias("score")))
    each = scored.select(F.col("label").alias("y"), F.explode(F.array(*scores)).alias("c")).select("c.split", "c.model", "c.score", "y", F.lit(1).cast("long").alias("n"))
    if few:
        each = each.unionByName(TR.scores(cells))
    counts = checkpointed(each.where("score is not null").groupBy("split", "model", "score", "y").agg(F.sum("n").alias("n")))
    return M.auc(counts, groups=("split", "model"), weight="n")


@query
def tree_models(spark, d):
    """AUC of boosted trees, a forest and naive Bayes on rows by chance and in time."""
    rows, second = _lines(spark, d).withColumnRenamed("y", "label"), F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    # One number, found once: every pass of every fit reads the lines alone.
    cut = exact_quantiles(rows, second, [0.8]).select(F.get("cuts", F.lit(0))).first()[0]
    return _areas_of_trees(rows.withColumn("late", second > F.lit(cut).cast("double")), FEATURES)


# --- clusters


def _vectors(spark, d):
    return V.vectors(spark, d).select("id", "x")


@query
def cluster_reseed(spark, d):
    return CL.reseed_agreement(_vectors(spark, d), 5)


@query
def cluster_resample(spark, d):
    return CL.resample_agreement(_vectors(spark, d), 5)


@query
def cluster_inertia(spark, d):
    return CL.inertia_curve(_vectors(spark, d), [2, 4, 6])


@query
def cluster_verdict(spark, d):
    return CL.assess(_vectors(spark, d), 10)


@query
def shuffled_columns(spark, d):
    """The null of every vector: coordinates weighted by their place, before and after each column was permuted."""
    weighted = lambda rows, name: rows.select("id", F.aggregate(F.transform("x", lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda s, v: s + v).alias(name))
    rows = _vectors(spark, d)
    return weighted(rows, "before").join(weighted(CL.shuffled_columns(rows), "after"), "id")


@query
def adjusted_rand(spark, d):
    """Labels of the vectors against their id's remainder by five."""
    rows = V.vectors(spark, d)
    return CL.adjusted_rand(rows.select("id", "label"), rows.select("id", (F.col("id") % 5).alias("label")))


# --- recommenders


def _interactions(spark, d):
    """The purchases are joined once and written, as counting users, items and the quantile of time each read them."""
    ledger = V.ledger(spark, d).where("not is_return")
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat("p_brand", F.lit("/"), "p_type").alias("product"))
    rows = checkpointed(ledger.select(F.col("customer").alias("user"), "item", "ts").join(parts, "item").select("user", F.col("product").alias("item"), "ts"))
    return checkpointed(RE.temporal_split(RE.build_interactions(rows)))


def _sides(spark, d):
    rows = _interactions(spark, d)
    train, test = rows.where("role = 'train'").drop("role"), rows.where("role = 'test'").drop("role")
    return train, test, test.select("user").distinct()


@query
def interactions(spark, d):
    return _interactions(spark, d).groupBy("role").agg(F.count("*").alias("rows"), F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))


@query
def recommend_popularity(spark, d):
    train, _, users = _sides(spark, d)
    return RE.popularity(train, users)


@query
def item_similarity(spark, d):
    return RE.item_similarity(_sides(spark, d)[0], neighbours=10)


def _recommender(name, make):
    def run(spark, d):
        train, test, users = _sides(spark, d)
        return RE.evaluate(make(train, users), train, test)

    run.__name__ = f"ranking_{name}"
    return query(run)


_recommender("popularity", RE.popularity)
_recommender("item_knn", RE.item_knn)
_recommender("random", RE.random_items)
_recommender("als", lambda train, users: RE.als(train, users, factors=32, iterations=12))


# --- decompositions


@query
def pca_variance(spark, d):
    found = RD.pca(_vectors(spark, d), 10)
    return spark.createDataFrame([(k, float(v), float(c)) for k, (v, c) in enumerate(zip(found.explained, found.cumulative, strict=True))], "component int, share double, cumulative double")


@query
def svd_variance(spark, d):
    found = RD.truncated_svd(_vectors(spark, d), 10)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(found.explained)], "component int, share double")


@query
def nmf_weights(spark, d):
    found = RD.nmf(RD.build_matrix(V.ledger(spark, d)), 4, iterations=10)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(found.explained)], "component int, share double")


@query
def embedding_quality(spark, d):
    rows = _vectors(spark, d)
    found = RD.pca(rows, 8)
    flat = found.embed(rows)
    measures = RD.neighbourhoods_kept(rows, flat).crossJoin(RD.pairwise_distance_corr(rows, flat))
    return measures.crossJoin(found.reconstruction_error(rows))


@query
def customer_matrix(spark, d):
    return RD.build_matrix(V.ledger(spark, d)).select("id", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"))


# --- anomalies


def _detectors(spark, d):
    rows = _vectors(spark, d)
    return {"mahalanobis": AN.mahalanobis(rows).cache(), "isolation": AN.isolation_forest(rows, trees=300).cache(), "lof": AN.local_outlier_factor(rows, neighbours=20).cache()}


@query
def mahalanobis(spark, d):
    return AN.mahalanobis(_vectors(spark, d))


@query
def local_outlier_factor(spark, d):
    return AN.local_outlier_factor(_vectors(spark, d), neighbours=20)


@query
def isolation_forest(spark, d):
    return AN.isolation_forest(_vectors(spark, d), trees=300)


@query
def detector_agreement(spark, d):
    return AN.agreement_matrix(_detectors(spark, d), k=25)


@query
def detector_precision(spark, d):
    labels = V.vectors(spark, d).select("id", (F.col("label") == 0).cast("int").alias("y"))
    return AN.at_k(AN.mahalanobis(_vectors(spark, d)), labels, [10, 25, 50, 100])


# --- time series


@query
def stationarity(spark, d):
    from pyspark.sql import Window

    daily = V.daily(spark, d).select(F.lit("level").alias("series"), "idx", "value")
    change = daily.withColumn("value", F.col("value") - F.lag("value").over(Window.partitionBy("series").orderBy("idx"))).where("value is not null").withColumn("series", F.lit("change"))
    return TS.stationarity(daily.unionByName(change))


@query
def spurious_regression(spark, d):
    found = TS.spurious_regression(spark, 200, trials=300)
    return found.groupBy("kind").agg(F.avg(F.col("significant").cast("double")).alias("significant"), F.count("*").alias("trials"))


@query
def refitted_forecasts(spark, d):
    """ARIMA and Holt, refitted at each fold, with the random walk's scale."""
    series = V.monthly(spark, d).select("idx", "value").cache()
    forecasts = TS.fold_forecasts(series, FC.evenly_spaced(48, series.count(), 6, 5), 6)
    scores = FC.fold_scores(forecasts, FC.scales(series, 1))
    return scores.groupBy("model").agg(F.avg("mase").alias("mase"), F.avg("bias").alias("bias"), F.count("*").alias("folds"))


# --- regularisation


def _engineered(spark, d):
    rows = _lines(spark, d).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("tax", F.col("l_extendedprice") * F.col("l_tax"))
    columns = [*FEATURES, "price", "net", "tax"]
    return CA.standardise(rows, rows, columns).select("id", "y", "part", *columns), columns


@query
def correlated_pairs(spark, d):
    rows, columns = _engineered(spark, d)
    return RG.correlated_pairs(rows, columns)


@query
def penalties(spark, d):
    rows, columns = _engineered(spark, d)
    models = [RG.penalty_model(p, 0.01) for p in ("none", "l2", "l1", "elasticnet")]
    return RG.fit_penalised(rows.where("part < 4"), rows.where("part = 4"), columns, models)[0]


@query
def penalty_conditions(spark, d):
    """Sums of column x fitted probability plus the penalty's pull, of penalised fits and of bootstrap replicates.

    At an optimum they are the sums of column x label, weighted by the draws, which the labels alone give.
    """
    rows, columns = _engineered(spark, d)
    models = [RG.penalty_model(p, 0.002) for p in ("none", "l2", "l1", "elasticnet")] + [Model(f"replicate/{r}", 0.002, 1.0, r) for r in range(6)]
    return moments(rows, columns, fit_all(rows, columns, models)).withColumn("moment", F.round("moment", 2))


@query
def regularisation_path(spark, d):
    rows, columns = _engineered(spark, d)
    return RG.regularisation_path(rows.where("part < 4"), rows.where("part = 4"), columns, strengths=[1e-4, 1e-3, 1e-2, 1.0])


@query
def selection_stability(spark, d):
    rows, columns = _engineered(spark, d)
    return RG.selection_frequency(spark, RG.bootstrap_fits(rows.select("id", "y", *columns), columns, c=0.01, replicates=200), columns)


@query
def pairwise_stability(spark, d):
    rows, columns = _engineered(spark, d)
    return RG.pairwise_stability(spark, RG.bootstrap_fits(rows.select("id", "y", *columns), columns, c=0.01, replicates=40, seed=1))


@query
def kalman_innovations(spark, d):
    """Exact filters of ARMA processes of fixed coefficients over the standardised steps of the monthly series."""
    from pyspark.sql import Window

    steps = V.monthly(spark, d).select("idx", (F.col("value") - F.lag("value").over(Window.orderBy("idx"))).alias("value")).where("value is not null")
    figures = steps.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = steps.crossJoin(F.broadcast(figures)).select(F.lit("monthly").alias("series"), "idx", ((F.col("value") - F.col("m")) / F.col("s")).alias("value"))
    one = TS.innovations(z, [0.5], [0.4]).withColumn("model", F.lit("101"))
    two = TS.innovations(z, [0.3, -0.2], [-0.6]).withColumn("model", F.lit("201"))
    return one.unionByName(two).select("model", "idx", "innovation", "variance")
