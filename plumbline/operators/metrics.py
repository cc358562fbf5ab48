"""Metrics of scored rows (id, y, score), with y 1 or 0. Null and not-a-number scores are skipped.

All metrics start from counts by distinct score, so ties are exact and one aggregation serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles, running_totals


def by_score(scored: DataFrame, *, digits: int | None = None, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, score, n, pos): rows and positives of each distinct (rounded) score; a row of ``scored`` may stand for ``weight`` rows."""
    rows = scored.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isNotNull())
    score = F.col("score") if digits is None else F.round("score", digits)
    if weight:
        return rows.groupBy(*groups, score.alias("score")).agg(F.sum(weight).alias("n"), F.sum(F.col(weight) * F.col("y")).alias("pos"))
    return rows.groupBy(*groups, score.alias("score")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def confusion_points(scored: DataFrame, *, digits: int | None = None) -> DataFrame:
    """(score, tp, fp, fn, tn, p, m): the confusion counts of predicting score >= each distinct score."""
    each = by_score(scored, digits=digits)
    total = each.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    run = running_totals(each, "score", {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")}, descending=True).crossJoin(F.broadcast(total))
    return run.select("score", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("m") - F.col("fp")).alias("tn"), "p", "m")


def precision_recall(scored: DataFrame) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    return confusion_points(scored).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row (average_precision): the sum over distinct scores of the gain in recall times precision."""
    each = by_score(scored)
    total = each.agg(F.sum("pos").alias("p"))
    run = running_totals(each, "score", {"tp": F.col("pos"), "seen": F.col("n")}, descending=True).crossJoin(F.broadcast(total))
    return run.agg(F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("pos") / F.col("p") * F.col("tp") / F.col("seen"))), F.lit(0.0)).alias("average_precision"))


def roc(scored: DataFrame) -> DataFrame:
    """(score, fpr, tpr) at each distinct score; rows of equal scores are one step."""
    points = confusion_points(scored)
    return points.select("score", (F.col("fp") / F.greatest("m", F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("tpr"))


def auc(scored: DataFrame, *, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, auc): the share of (positive, negative) pairs in order, ties counting half; 0.5 if a class is missing."""
    each = by_score(scored, groups=groups, weight=weight)
    run = running_totals(each, "score", {"negatives": F.col("n") - F.col("pos")}, groups=groups)
    own = F.col("n") - F.col("pos")
    figures = run.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("negatives") - own / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum(own).alias("m"))
    return figures.select(*groups, F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("wins") / (F.col("p") * F.col("m"))).otherwise(0.5).alias("auc"))


def evaluate_at(scored: DataFrame, thresholds: list[float], *, cost_miss: float, cost_alarm: float) -> DataFrame:
    """(threshold, cost, tp, fp, fn, tn, recall, precision, accuracy) of predicting score >= threshold, in one pass."""
    picks = scored.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    # Each score is counted at the last threshold that it reaches; suffix sums over thresholds do the rest.
    sorted_cuts = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    reach = by_score(scored).withColumn("k", F.size(F.filter(sorted_cuts, lambda c: c <= F.col("score")))).groupBy("k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rank = picks.withColumn("k", F.row_number().over(Window.orderBy("threshold")))
    total = reach.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    hit = rank.join(reach.withColumnRenamed("k", "own"), F.col("own") >= F.col("k"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("fp"))
    out = hit.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("m") - F.col("fp")).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("threshold", (fn * cost_miss + fp * cost_alarm).alias("cost"), "tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def linspace(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * k / (steps - 1) for k in range(steps)]


def cost_curve(scored: DataFrame, *, cost_miss: float, cost_alarm: float, steps: int = 400) -> DataFrame:
    """(threshold, cost, ...) on a uniform grid of [0, 1]."""
    return evaluate_at(scored, linspace(0.0, 1.0, steps), cost_miss=cost_miss, cost_alarm=cost_alarm)


def best_threshold(scored: DataFrame, *, cost_miss: float, cost_alarm: float, steps: int = 400) -> DataFrame:
    """The row of the cost curve with the least cost; the lowest threshold of equal ones."""
    return cost_curve(scored, cost_miss=cost_miss, cost_alarm=cost_alarm, steps=steps).orderBy("cost", "threshold").limit(1)


def choose_threshold(scored: DataFrame, *, cost_fn: float, cost_fp: float) -> DataFrame:
    """The rounded score (4 digits) of least expected cost, the lowest of equal ones; scores themselves are not rounded."""
    each = by_score(scored)
    cuts = each.select(F.round("score", 4).alias("score"), F.lit(0).alias("n"), F.lit(0).alias("pos")).distinct()
    both = each.unionByName(cuts.withColumn("n", F.lit(0).cast("long")).withColumn("pos", F.lit(0).cast("long")))
    both = both.groupBy("score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = each.agg(F.sum("pos").alias("p"))
    run = running_totals(both, "score", {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")}, descending=True)
    run = run.join(cuts.select("score"), "score").crossJoin(F.broadcast(total)).withColumn("fn", F.col("p") - F.col("tp"))
    out = run.withColumn("expected_cost", F.col("fn") * float(cost_fn) + F.col("fp") * float(cost_fp)).orderBy("expected_cost", "score").limit(1)
    return out.select(F.col("score").alias("threshold"), "expected_cost", "tp", "fp", "fn", F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0).alias("recall"))


def brier(scored: DataFrame) -> DataFrame:
    """One row (brier): the mean squared error of the score as a probability."""
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"))


def uniform_bin(score: Column, bins: int) -> Column:
    """The number of inner edges of a uniform grid of [0, 1] that ``score`` reaches."""
    return F.size(F.filter(F.array(*(F.lit(e) for e in linspace(0.0, 1.0, bins + 1)[1:-1])), lambda e: e <= score))


def _per_bin(binned: DataFrame, bins: int) -> DataFrame:
    cells = binned.groupBy("bin").agg(F.avg("score").alias("predicted"), F.avg("y").alias("observed"), F.count("*").alias("n"))
    return binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(cells, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_curve(scored: DataFrame, *, bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n) on uniform bins; empty bins stay, with nulls."""
    return _per_bin(scored.withColumn("bin", uniform_bin(F.col("score"), bins)), bins)


def quantile_reliability(scored: DataFrame, *, bins: int = 12, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, bin, predicted, observed, n) on quantile bins: a bin begins at an inner distinct quantile and holds at least one row.

    ``groups`` are few; a row may stand for ``weight`` rows.
    """
    q = [k / bins for k in range(bins + 1)]
    edges = exact_quantiles(scored, "score", q, "edges", groups=groups, weight=weight).select(*groups, F.array_distinct("edges").alias("edges"))
    inner = edges.select(*groups, F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"))
    joined = scored.join(F.broadcast(inner), list(groups), "left") if groups else scored.crossJoin(F.broadcast(inner))
    binned = joined.withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("score"))))
    if weight is None:
        return binned.groupBy(*groups, "bin").agg(F.avg("score").alias("predicted"), F.avg("y").alias("observed"), F.count("*").alias("n"))
    mean = lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))
    return binned.groupBy(*groups, "bin").agg(mean("score").alias("predicted"), mean("y").alias("observed"), F.sum(weight).alias("n"))


def calibration_errors(scored: DataFrame, *, bins: int = 12, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, ece, mce), one row without groups: weighted mean and largest gap of the quantile reliability bins."""
    gap = F.abs(F.col("predicted") - F.col("observed"))
    cells = quantile_reliability(scored, bins=bins, groups=groups, weight=weight)
    return cells.groupBy(*groups).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def top_k(scored: DataFrame, k: int | Column) -> DataFrame:
    """The k rows of highest score (ties: lowest id); k may be a column of a broadcast one-row frame."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def lift_at_k(scored: DataFrame, *, share: float = 0.1) -> DataFrame:
    """One row (lift, precision, k): precision among the top share of rows over the base rate."""
    each = by_score(scored)
    total = each.agg(F.sum("n").alias("all"), F.sum("pos").alias("p"))
    run = running_totals(each, "score", {"seen": F.col("n")}, descending=True).crossJoin(F.broadcast(total)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("all") * share)))
    # Whole scores above the cut count; of the score at the cut, rows of the lowest ids do.
    edge = run.where((F.col("seen") >= F.col("k")) & (F.col("seen") - F.col("n") < F.col("k"))).select("score", "k", "all", "p", (F.col("k") - F.col("seen") + F.col("n")).alias("take"))
    whole = run.where("seen < k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("hits"))
    need = edge.first()
    if need is None:
        return scored.sparkSession.createDataFrame([], "lift double, precision double, k long")
    cut = scored.where(F.col("score") == F.lit(need["score"])).select("id", "y").orderBy("id").limit(int(need["take"])).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("more"))
    hit = (F.col("hits") + F.col("more")) / F.lit(need["k"])
    base = need["p"] / need["all"]
    return whole.crossJoin(cut).select((hit / F.lit(base) if base else F.lit(0.0)).alias("lift"), hit.alias("precision"), F.lit(need["k"]).cast("long").alias("k"))


def campaign_value(scored: DataFrame, *, share: float, value: float, cost: float) -> DataFrame:
    """One row (calls, subscriptions, conversion, profit, lift) of calling the top share of rows."""
    at = lift_at_k(scored, share=share)
    subs = F.round(F.col("precision") * F.col("k")).cast("long")
    return at.select(F.col("k").alias("calls"), subs.alias("subscriptions"), F.col("precision").alias("conversion"), (subs * float(value) - F.col("k") * float(cost)).alias("profit"), "lift")


def money_at_stake(scored: DataFrame, *, exposure: float, loss_given_default: float) -> DataFrame:
    """One row (expected, actual, error_pct): what the probabilities say will be lost, and what was."""
    unit = float(exposure) * float(loss_given_default)
    sums = scored.agg((F.sum("score") * unit).alias("expected"), (F.sum("y") * unit).alias("actual"))
    return sums.select("expected", "actual", F.when(F.col("actual") > 0, (F.col("expected") - F.col("actual")) / F.col("actual") * 100).alias("error_pct"))


def poisson_deviance(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row (deviance): twice the mean of y ln(y / mu) - (y - mu), with mu at least 1e-9."""
    mu, y = F.greatest(F.col(predicted), F.lit(1e-9)), F.col(actual)
    return rows.agg((2 * F.avg(F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))).alias("deviance"))
