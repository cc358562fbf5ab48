"""The query registry: each operator over the test tables, with doubles rounded at the edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.running import trapezoid
from plumbline.operators import backtest as BT
from plumbline.operators import basket as BK
from plumbline.operators import elasticity as EL
from plumbline.operators import elo as ELO
from plumbline.operators import encoding as EN
from plumbline.operators import forecast as FC
from plumbline.operators import leak as LK
from plumbline.operators import ledger as LG
from plumbline.operators import metrics as M
from plumbline.operators import overlap as OV
from plumbline.operators import regimes as RG
from plumbline.operators import splits as SP
from plumbline.operators import survival as SV
from plumbline.session import checkpointed
from plumbline.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def edge(df: DataFrame) -> DataFrame:
    """Doubles rounded to ``DIGITS`` (without negative zeros), counts as longs."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, DIGITS) + 0.0).alias(name) if kind == "double" else c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: edge(f(spark, sf_dir))
    return f


def _daily(spark, d):
    """The daily series (series, idx, value)."""
    return V.daily(spark, d).select(F.lit("daily").alias("series"), "idx", "value")


def _monthly(spark, d):
    return V.monthly(spark, d).select(F.lit("monthly").alias("series"), "idx", "value", "x")


def _customers(spark, d):
    return LG.rfm(V.ledger(spark, d))


# --- customer value


@query
def rfm(spark, d):
    return _customers(spark, d)


@query
def rfm_purchases_only(spark, d):
    return LG.rfm(V.ledger(spark, d), purchases_only=True)


@query
def concentration(spark, d):
    """Values are net revenues to the cent, halves up, from exact sums."""
    return LG.concentration(LG.net_cents(V.ledger(spark, d)), "cents").withColumn("value", F.col("value") / 100)


@query
def value_gini(spark, d):
    return LG.gini(_customers(spark, d), "monetary")


@query
def top_share(spark, d):
    return LG.top_share(LG.net_cents(V.ledger(spark, d)), "cents", [0.01, 0.05, 0.1, 0.2, 0.5])


@query
def cohorts(spark, d):
    return LG.cohorts(V.ledger(spark, d))


@query
def cohorts_zero_fill(spark, d):
    return LG.cohorts(V.ledger(spark, d), zero_fill=True)


@query
def average_survival(spark, d):
    return LG.average_survival(LG.cohorts(V.ledger(spark, d)))


@query
def one_time_buyers(spark, d):
    return LG.one_time_buyers(_customers(spark, d))


@query
def value_at_risk(spark, d):
    return LG.value_at_risk(_customers(spark, d))


# --- metrics of scored rows


@query
def precision_recall(spark, d):
    return M.precision_recall(V.scored(spark, d))


@query
def average_precision(spark, d):
    return M.average_precision(V.scored_documents(spark, d))


@query
def roc(spark, d):
    return M.roc(V.scored(spark, d))


@query
def roc_area(spark, d):
    points = M.roc(V.scored_documents(spark, d)).select("fpr", "tpr")
    start = spark.createDataFrame([(0.0, 0.0)], "fpr double, tpr double")
    return trapezoid(points.unionByName(start), "fpr", "tpr")


@query
def tied_auc(spark, d):
    return M.auc(V.scored(spark, d))


@query
def evaluate_at(spark, d):
    return M.evaluate_at(V.scored(spark, d), [0.0, 0.25, 0.5, 0.75, 1.5], cost_miss=50.0, cost_alarm=1.0)


@query
def cost_curve(spark, d):
    return M.cost_curve(V.scored(spark, d), cost_miss=5.0, cost_alarm=2.0).select("threshold", "cost", "tp", "fp")


@query
def best_threshold(spark, d):
    return M.best_threshold(V.scored_documents(spark, d), cost_miss=1.0, cost_alarm=6.0)


@query
def choose_threshold(spark, d):
    return M.choose_threshold(V.scored_documents(spark, d), cost_fn=1.0, cost_fp=6.0)


@query
def brier(spark, d):
    return M.brier(V.scored_documents(spark, d))


@query
def calibration_curve(spark, d):
    return M.calibration_curve(V.scored_documents(spark, d))


@query
def quantile_reliability(spark, d):
    return M.quantile_reliability(V.scored_documents(spark, d))


@query
def calibration_errors(spark, d):
    return M.calibration_errors(V.scored_documents(spark, d))


@query
def lift_at_k(spark, d):
    return M.lift_at_k(V.scored(spark, d))


@query
def campaign_value(spark, d):
    return M.campaign_value(V.scored(spark, d), share=0.2, value=80.0, cost=5.0)


@query
def money_at_stake(spark, d):
    return M.money_at_stake(V.scored_documents(spark, d), exposure=1000.0, loss_given_default=0.45)


@query
def leak_audit(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return LK.audit_columns(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "returned"], "returned", {"l_quantity", "l_extendedprice", "l_linenumber"})


# --- splits


@query
def time_split(spark, d):
    n = V.daily(spark, d).count()
    return SP.time_split(V.daily(spark, d).select("idx"), n).groupBy("fold", "role").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


@query
def purged_time_split(spark, d):
    n = V.daily(spark, d).count()
    return SP.time_split(V.daily(spark, d).select("idx"), n, embargo=21).groupBy("fold", "role").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


@query
def group_split(spark, d):
    """Customers held out whole: no customer is on both sides."""
    orders = V.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"))
    return SP.group_split(orders, "customer").groupBy("customer").agg(F.countDistinct("role").alias("sides"), F.max((F.col("role") == "test").cast("int")).alias("held"), F.count("*").alias("orders"))


# --- backtests


@query
def rule_grid(spark, d):
    return BT.rule_grid(spark)


@query
def strategy_search(spark, d):
    return BT.run_search(_daily(spark, d), BT.rule_grid(spark)).drop("series")


@query
def strategy_search_shuffled(spark, d):
    return BT.run_search(BT.shuffled_series(_daily(spark, d)), BT.rule_grid(spark)).agg(F.count("*").alias("rules"), F.max("sharpe_ann").alias("best_by_luck"))


@query
def search_halves(spark, d):
    """Sharpe ratio of each rule in the first and second half of the days."""
    series = _daily(spark, d)
    n = series.agg((F.count("*") / 2).cast("int").alias("half"))
    returns = BT.strategy_returns(series, BT.rule_grid(spark)).crossJoin(F.broadcast(n))
    return returns.groupBy("rule").agg((BT.sharpe_if("ret", F.col("idx") < F.col("half"))).alias("in_sample"), (BT.sharpe_if("ret", F.col("idx") >= F.col("half"))).alias("out_of_sample"))


@query
def return_moments(spark, d):
    w = Window.partitionBy("series").orderBy("idx")
    return BT.return_moments(_daily(spark, d).withColumn("ret", F.col("value") / F.lag("value").over(w) - 1))


def best_rule(trials):
    """The rule of the highest ratio to nine digits; of equal ones the first by name (reversion ignores the fast length)."""
    return trials.orderBy(F.round("sharpe_ann", 9).desc(), "rule").select("rule").first()["rule"]


@query
def deflated_sharpe(spark, d):
    """The verdict on the best rule of the search (to nine digits, ties by name), given all trials."""
    series, rules = _daily(spark, d), BT.rule_grid(spark)
    trials = checkpointed(BT.run_search(series, rules))  # a row a rule
    best = best_rule(trials)
    returns = BT.strategy_returns(series, rules.where(F.col("rule") == best))
    found = BT.deflated_sharpe(returns, trials, rules.count())
    return found.select(F.lit(best).alias("rule"), "observed_ann", "benchmark_ann", "probability_real", F.lit(rules.count()).alias("n_trials"), F.col("n").alias("n_observations"), "survives", "min_track_record")


# --- ratings and forecasts of matches


def _elo(spark, d):
    matches = V.matches(spark, d).withColumn("league", F.lit("all"))
    ratings = ELO.walk_forward(matches)
    return matches.join(ratings, ["league", "idx"])


def _odds():
    """Odds of a deterministic bookmaker: cycling with the match's place."""
    return F.array(1.5 + (F.col("idx") % 7) * 0.25, 3.0 + (F.col("idx") % 3) * 0.3, 2.0 + (F.col("idx") % 5) * 0.4)


@query
def elo_ratings(spark, d):
    return _elo(spark, d).select("idx", "home_rating", "away_rating", "expected")


@query
def elo_scores(spark, d):
    return ELO.forecast_scores(_elo(spark, d).select(ELO.three_way(F.col("expected")).alias("p"), "outcome"))


@query
def odds_probabilities(spark, d):
    m = V.matches(spark, d).withColumn("odds", _odds()).withColumn("p", ELO.implied_probabilities(F.col("odds")))
    return m.select("idx", F.get("p", F.lit(0)).alias("p_home"), F.get("p", F.lit(1)).alias("p_draw"), F.get("p", F.lit(2)).alias("p_away"), ELO.overround(F.col("odds")).alias("overround"))


@query
def forecast_scores(spark, d):
    m = V.matches(spark, d).withColumn("odds", _odds())
    return ELO.forecast_scores(m.select(ELO.implied_probabilities(F.col("odds")).alias("p"), "outcome"))


@query
def base_rate_scores(spark, d):
    m = V.matches(spark, d)
    base = m.agg(F.array(*(F.avg((F.col("outcome") == k).cast("double")) for k in range(3))).alias("p"))
    return ELO.forecast_scores(m.crossJoin(F.broadcast(base)))


@query
def pooled_reliability(spark, d):
    m = V.matches(spark, d).withColumn("odds", _odds())
    return ELO.pooled_reliability(m.select(ELO.implied_probabilities(F.col("odds")).alias("p"), "outcome"))


@query
def betting_favourite(spark, d):
    m = V.matches(spark, d).withColumn("odds", _odds())
    return ELO.betting_roi(m, F.array_position("odds", F.array_min("odds")).cast("int") - 1)


@query
def betting_edge(spark, d):
    """Bets where the rating sees more than the odds do."""
    m = _elo(spark, d).withColumn("odds", _odds())
    edges = F.zip_with(ELO.three_way(F.col("expected")), ELO.implied_probabilities(F.col("odds")), lambda a, b: a - b)
    m = m.withColumn("edges", edges)
    return ELO.betting_roi(m, F.array_position("edges", F.array_max("edges")).cast("int") - 1, only=F.array_max("edges") > 0)


# --- regimes


@query
def hindsight_labels(spark, d):
    return RG.hindsight_labels(_daily(spark, d)).select("idx", "label")


@query
def realtime_labels(spark, d):
    return RG.realtime_labels(_daily(spark, d)).select("idx", "label")


@query
def regime_transitions(spark, d):
    return RG.transition_matrix(RG.hindsight_labels(_daily(spark, d)))


@query
def regime_persistence(spark, d):
    return RG.persistence(RG.realtime_labels(_daily(spark, d)))


@query
def regime_runs(spark, d):
    return RG.runs(RG.realtime_labels(_daily(spark, d))).drop("series")


@query
def regime_disagreement(spark, d):
    return RG.compare(RG.hindsight_labels(_daily(spark, d)), RG.realtime_labels(_daily(spark, d)))


@query
def regime_detection_lag(spark, d):
    return RG.detection_lag(RG.hindsight_labels(_daily(spark, d)), RG.realtime_labels(_daily(spark, d))).drop("series")


@query
def realised_volatility(spark, d):
    w = Window.partitionBy("series").orderBy("idx")
    return RG.realised_volatility(_daily(spark, d).withColumn("ret", F.log(F.col("value") / F.lag("value").over(w)))).select("idx", "volatility")


# --- overlapping windows


@query
def forward_return(spark, d):
    return OV.forward_return(_monthly(spark, d), 12).select("idx", "forward")


def _overlap(spark, d):
    return OV.forward_return(_monthly(spark, d), 12).where("forward is not null").select("idx", "x", F.col("forward").alias("y"))


@query
def ols_overlapping(spark, d):
    return _overlap(spark, d).agg(*OV.ols())


@query
def newey_west(spark, d):
    return OV.newey_west(_overlap(spark, d), lags=11)


@query
def disjoint_regression(spark, d):
    return OV.disjoint(_overlap(spark, d), 12, offset=3).agg(*OV.ols())


@query
def offset_sweep(spark, d):
    return OV.offset_sweep(_overlap(spark, d), 6).select("offset", "slope", "se", "n")


# --- forecasts


@query
def forecast_evaluation(spark, d):
    n = V.daily(spark, d).count()
    return FC.evaluate(V.daily(spark, d).select("idx", "value"), SP.rolling_origins(n, horizon=7, step=7, min_train=120))


@query
def forecast_evaluation_embargo(spark, d):
    n = V.daily(spark, d).count()
    return FC.evaluate(V.daily(spark, d).select("idx", "value"), SP.rolling_origins(n, horizon=7, step=28, min_train=120), embargo=5)


@query
def rolling_backtest(spark, d):
    """One-step scaled backtest of random walk, drift and trailing mean over the months."""
    n = V.monthly(spark, d).count()
    return FC.evaluate(V.monthly(spark, d).select("idx", "value"), FC.evenly_spaced(36, n, 6, 10), horizon=6, season=1, models=("random_walk", "drift", "trailing_mean"))


# --- elasticity


def _panel(spark, d):
    """Products by brand: the panel of single parts is too thin here."""
    ledger = V.ledger(spark, d)
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat("p_brand", F.lit("/"), "p_type").alias("product"))
    return EL.product_month_panel(ledger.join(parts, "item").drop("item").withColumnRenamed("product", "item"))


@query
def product_month_panel(spark, d):
    return _panel(spark, d).select("item", "month", "units", "revenue", "price", "log_units", "log_price")


@query
def elasticity_pooled(spark, d):
    return EL.naive_elasticity(_panel(spark, d))


@query
def elasticity_within(spark, d):
    return EL.within_product(_panel(spark, d))


@query
def elasticity_within_month(spark, d):
    return EL.within_product_and_month(_panel(spark, d))


@query
def elasticity_per_product(spark, d):
    return EL.per_product(_panel(spark, d))


# --- survival

CUTOFF = "1997-01-01"


def _gaps(spark, d):
    return SV.order_gaps(V.ledger(spark, d), cutoff=CUTOFF)


@query
def survival_cohort(spark, d):
    return _gaps(spark, d)


@query
def censoring_rate(spark, d):
    return SV.censoring_rate(_gaps(spark, d))


@query
def kaplan_meier(spark, d):
    return SV.kaplan_meier(_gaps(spark, d))


@query
def median_survival(spark, d):
    return SV.median_survival(SV.kaplan_meier(_gaps(spark, d)))


@query
def survival_at(spark, d):
    return SV.survival_at(SV.kaplan_meier(_gaps(spark, d)), [0.0, 30.0, 90.0, 365.0])


def _gaps_by_half(spark, d):
    return _gaps(spark, d).withColumn("b", F.col("customer") % 2 == 1)


@query
def log_rank(spark, d):
    return SV.log_rank_sums(_gaps_by_half(spark, d), "b")


@query
def concordance(spark, d):
    return SV.concordance(_gaps(spark, d).withColumn("risk", F.col("first_items").cast("double")))


@query
def cox_regression(spark, d):
    rows = _gaps(spark, d).select("duration", "observed", (F.col("first_value") / 100_000).alias("value"), F.col("first_items").cast("double").alias("items"))
    fit = SV.fit_cox(rows, ["value", "items"])
    return spark.createDataFrame([tuple(r.values()) for r in fit.hazard_ratios()], "covariate string, coefficient double, hazard_ratio double, lower double, upper double, z double, p_value double")


# --- target encoding


def _categories(spark, d):
    """Lines with the part as category and their return as target; the later three quarters by key are train."""
    lines = V.table(spark, d, "lineitem")
    split = F.when(F.col("l_orderkey") % 4 < 3, "train").otherwise("test")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("category"), (F.col("l_returnflag") == "R").cast("int").alias("y"), split.alias("split"))


@query
def category_means(spark, d):
    return EN.category_means(_categories(spark, d), smoothing=20.0)


@query
def encoding_naive(spark, d):
    return EN.naive_encoding(_categories(spark, d)).drop("category")


@query
def encoding_train_only(spark, d):
    return EN.train_only_encoding(_categories(spark, d))


@query
def encoding_smoothed(spark, d):
    return EN.train_only_encoding(_categories(spark, d), smoothing=50.0)


@query
def encoding_out_of_fold(spark, d):
    return EN.out_of_fold_encoding(_categories(spark, d), fold=F.col("id") % 5)


@query
def cardinality_profile(spark, d):
    return EN.cardinality_profile(_categories(spark, d))


@query
def leak_by_rarity(spark, d):
    return EN.leak_by_rarity(EN.naive_encoding(_categories(spark, d)))


# --- association rules


@query
def basket_sizes(spark, d):
    return BK.build_baskets(V.baskets(spark, d)).groupBy("size").agg(F.countDistinct("basket").alias("baskets"))


@query
def item_counts(spark, d):
    return BK.item_counts(BK.build_baskets(V.baskets(spark, d)))


@query
def pair_counts(spark, d):
    return BK.pair_counts(BK.build_baskets(V.baskets(spark, d, "p_partkey")))


@query
def association_rules(spark, d):
    return BK.build_rules(BK.build_baskets(V.baskets(spark, d)))


@query
def permutation_null(spark, d):
    return BK.permutation_null(BK.build_baskets(V.baskets(spark, d)), replicates=20)


@query
def rules_holdout(spark, d):
    """Rules of the earlier half of the invoices, measured in the later."""
    baskets = V.baskets(spark, d)
    middle = baskets.agg((F.max("basket") / 2).alias("m"))
    early = BK.build_baskets(baskets.crossJoin(F.broadcast(middle)).where("basket <= m").drop("m"))
    late = BK.build_baskets(baskets.crossJoin(F.broadcast(middle)).where("basket > m").drop("m"))
    return BK.holdout_check(BK.build_rules(early), late)
