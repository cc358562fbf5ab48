"""Survival of (duration, observed) rows: Kaplan-Meier, log-rank, Cox and concordance.

All start from counts by distinct duration. Risk sets are running totals from the longest duration down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import running_totals
from plumbline.functions.stats import normal_cdf
from plumbline.functions.tails import chi2_tail


def order_gaps(ledger: DataFrame, *, cutoff: str | None = None, least: float = 0.5) -> DataFrame:
    """(customer, duration, observed, first_value, first_items): days from first to second invoice, or to the end.

    ``cutoff`` (a date) ends the observation before the data do: what follows is not seen.
    """
    rows = ledger.where("customer is not null")
    if cutoff:
        rows = rows.where(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"))
    orders = rows.groupBy("customer", "invoice").agg(F.min("ts").alias("ts"), F.sum("revenue").alias("value"), F.count("*").alias("items"))
    w = Window.partitionBy("customer").orderBy("ts", "invoice")
    first = orders.withColumn("next", F.lead("ts").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    end = rows.agg(F.max("ts").alias("end"))
    days = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400e6
    gap = F.when(F.col("next").isNotNull(), days(F.col("next"), F.col("ts"))).otherwise(days(F.col("end"), F.col("ts")))
    return first.crossJoin(F.broadcast(end)).select("customer", F.greatest(gap, F.lit(least)).alias("duration"), F.col("next").isNotNull().alias("observed"), F.col("value").alias("first_value"), F.col("items").alias("first_items"))


def censoring_rate(rows: DataFrame) -> DataFrame:
    """One row (censoring_rate, naive_event_rate)."""
    seen = F.avg(F.col("observed").cast("double"))
    return rows.agg((1 - seen).alias("censoring_rate"), seen.alias("naive_event_rate"))


def event_table(rows: DataFrame) -> DataFrame:
    """(time, at_risk, events) of each duration with an event; those censored at a time are still at risk."""
    each = rows.groupBy(F.col("duration").alias("time")).agg(F.count("*").alias("k"), F.sum(F.col("observed").cast("int")).alias("events"))
    return running_totals(each, "time", {"at_risk": F.col("k")}, descending=True).where("events > 0").select("time", "at_risk", "events")


def kaplan_meier(rows: DataFrame) -> DataFrame:
    """(time, at_risk, events, survival, lower, upper); Greenwood's error stops growing where all have the event."""
    steps = event_table(rows)
    survives = (F.col("at_risk") > F.col("events"))
    log_step = F.when(survives, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    green = F.when(survives, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0)
    run = running_totals(steps, "time", {"log_s": log_step, "g": green, "ended": F.when(survives, 0).otherwise(1)})
    survival = F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("log_s"))
    out = run.withColumn("survival", survival).withColumn("e", 1.96 * F.col("survival") * F.sqrt("g"))
    return out.select("time", "at_risk", "events", "survival", F.greatest(F.lit(0.0), F.col("survival") - F.col("e")).alias("lower"), F.least(F.lit(1.0), F.col("survival") + F.col("e")).alias("upper"))


def median_survival(curve: DataFrame) -> DataFrame:
    """One row (median): the first time with survival of a half or less, else infinity."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))), F.lit(float("inf"))).alias("median"))


def survival_at(curve: DataFrame, times: list[float]) -> DataFrame:
    """(t, survival): the curve at the last event time up to t, 1 before the first."""
    picks = curve.sparkSession.createDataFrame([(float(t),) for t in times], "t double")
    return F.broadcast(picks).join(curve, F.col("time") <= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.max_by("survival", "time"), F.lit(1.0)).alias("survival"))


def log_rank_sums(rows: DataFrame, group: str) -> DataFrame:
    """One row (observed_a, expected_a, variance, chi2) of the group that is not ``group``'s true."""
    a = (~F.col(group)).cast("int")
    each = rows.groupBy(F.col("duration").alias("time")).agg(F.count("*").alias("k"), F.sum(a).alias("ka"), F.sum(F.col("observed").cast("int")).alias("d"), F.sum(F.col("observed").cast("int") * a).alias("da"))
    run = running_totals(each, "time", {"n": F.col("k"), "na": F.col("ka")}, descending=True).where("n >= 2 and d > 0")
    share = F.col("na") / F.col("n")
    sums = run.agg(F.sum("da").alias("observed_a"), F.sum(F.col("d") * share).alias("expected_a"), F.sum(F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).alias("variance"))
    return sums.withColumn("chi2", F.when(F.col("variance") > 0, F.pow(F.col("observed_a") - F.col("expected_a"), 2) / F.col("variance")).otherwise(0.0))


def log_rank(rows: DataFrame, group: str) -> DataFrame:
    """``log_rank_sums`` with p_value, the tail of chi-squared with one degree."""
    return log_rank_sums(rows, group).withColumn("p_value", chi2_tail(F.col("chi2")))


@dataclass(frozen=True)
class Cox:
    columns: list[str]
    coefficients: list[float]
    standard_errors: list[float]
    log_likelihood: float
    n_observations: int
    n_events: int

    def hazard_ratios(self) -> list[dict]:
        out = []
        for name, b, e in zip(self.columns, self.coefficients, self.standard_errors, strict=True):
            z = b / e if e > 0 else 0.0
            out.append({"covariate": name, "coefficient": b, "hazard_ratio": float(np.exp(b)), "lower": float(np.exp(b - 1.96 * e)), "upper": float(np.exp(b + 1.96 * e)), "z": z, "p_value": 2 * (1 - normal_cdf(abs(z)))})
        return out


def fit_cox(rows: DataFrame, columns: list[str], *, iterations: int = 40, tolerance: float = 1e-7) -> Cox:
    """Newton steps on the Breslow partial likelihood; a step is one aggregation and a small solve.

    Rows are summed by duration, so risk sets are running totals over distinct durations.
    """
    p = len(columns)
    base = rows.select("duration", F.col("observed").cast("int").alias("d"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns))).cache()
    n, events = base.agg(F.count("*"), F.sum("d")).first()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta, likelihood, information = np.zeros(p), 0.0, np.eye(p)
    for _ in range(iterations):
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((float(b) * F.col(f"x{k}") for k, b in enumerate(beta)), F.lit(0.0))))
        weighted = base.withColumn("eta", eta).withColumn("w", F.exp("eta"))
        sums = {"w": F.sum("w"), **{f"wx{i}": F.sum(F.col("w") * F.col(f"x{i}")) for i in range(p)}, **{f"wxx{i}_{j}": F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs}}
        each = weighted.groupBy("duration").agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("eta")).alias("de"), *(F.sum(F.col("d") * F.col(f"x{i}")).alias(f"dx{i}") for i in range(p)), *(e.alias(k) for k, e in sums.items()))
        run = running_totals(each, "duration", {f"r_{k}": F.col(k) for k in sums}, descending=True).where("d > 0")
        mean = lambda i: F.col(f"r_wx{i}") / F.col("r_w")
        row = run.agg(
            F.sum(F.col("de") - F.col("d") * F.log("r_w")).alias("l"), *(F.sum(F.col(f"dx{i}") - F.col("d") * mean(i)).alias(f"g{i}") for i in range(p)),
            *(F.sum(F.col("d") * (F.col(f"r_wxx{i}_{j}") / F.col("r_w") - mean(i) * mean(j))).alias(f"h{i}_{j}") for i, j in pairs),
        ).first()
        likelihood, gradient = row["l"], np.array([row[f"g{i}"] for i in range(p)])
        for i, j in pairs:
            information[i, j] = information[j, i] = row[f"h{i}_{j}"]
        try:
            step = np.linalg.solve(information, gradient)
        except np.linalg.LinAlgError:
            break
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    base.unpersist()
    try:
        errors = np.sqrt(np.clip(np.diag(np.linalg.inv(information)), 0, None))
    except np.linalg.LinAlgError:
        errors = np.full(p, np.nan)
    return Cox(columns, beta.tolist(), errors.tolist(), float(likelihood), int(n), int(events or 0))


def concordance(rows: DataFrame) -> DataFrame:
    """One row (c_index, pairs): Harrell's index of ``risk``; 0.5 without comparable pairs.

    Rows are counted by (duration, risk) and durations numbered. Two numbers differ first in one bit, so each
    pair of durations meets once: at that bit, within the numbers that agree above it. There running counts
    over risk give the later rows below and at each event's risk: rows x bits in all, and no pair is formed.
    """
    each = rows.groupBy("duration", "risk").agg(F.count("*").alias("n"), F.sum(F.col("observed").cast("int")).alias("d"))
    times = each.select("duration").distinct()
    bits = max(1, times.count().bit_length())
    numbered = each.join(running_totals(times, "duration", {"t": F.lit(1)}), "duration")
    bit = numbered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("late", F.expr("shiftright(t, level) & 1") == 1)
    node = bit.groupBy("level", F.expr("shiftright(t, level + 1)").alias("node"), "risk")
    line = node.agg(F.sum(F.when(F.col("late"), 0).otherwise(F.col("d"))).alias("d"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n"))
    run = running_totals(line, "risk", {"upto": F.col("n")}, groups=("level", "node")).where("d > 0 or n > 0")
    figures = run.groupBy("level", "node").agg(F.sum(F.col("d") * (F.col("upto") - F.col("n"))).alias("c"), F.sum(F.col("d") * F.col("n")).alias("t"), (F.sum("d") * F.sum("n")).alias("all"))
    both = figures.agg(*(F.coalesce(F.sum(k), F.lit(0)).cast("double").alias(k) for k in ("c", "t", "all")))
    return both.select(F.when(F.col("all") > 0, (F.col("c") + F.col("t") / 2) / F.col("all")).otherwise(0.5).alias("c_index"), F.col("all").cast("long").alias("pairs"))
