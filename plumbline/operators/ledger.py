"""Customer value from a ledger: recency, frequency, monetary value, concentration and cohorts.

Ledgers have (invoice, customer, ts, is_return, revenue). Rows without a customer are left out of all
per-customer work; returns are kept and subtract.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import running_totals

_DAY = 86_400_000_000


def _elapsed_days(late, early):
    """Whole days between two timestamps, rounded down."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(late) - micros(early)) / _DAY)


def rfm(ledger: DataFrame, *, as_of: datetime.datetime | None = None, purchases_only: bool = False) -> DataFrame:
    """Recency, tenure, frequency, monetary value, returns and averages of each customer.

    ``as_of`` is the day after the last line unless given. Frequency counts invoices; returns count as
    such unless ``purchases_only``.
    """
    rows = ledger.where("customer is not null")
    if purchases_only:
        rows = rows.where(~F.col("is_return"))
    per = rows.groupBy("customer").agg(
        F.max("ts").alias("last"), F.min("ts").alias("first"), F.countDistinct("invoice").alias("frequency"), F.sum("revenue").alias("monetary"),
        F.coalesce(-F.sum(F.when(F.col("is_return"), F.col("revenue"))), F.lit(0.0)).alias("returned"),
    )
    if as_of is None:
        per = per.crossJoin(F.broadcast(rows.agg((F.max("ts") + F.expr("interval 1 day")).alias("as_of"))))
    else:
        per = per.withColumn("as_of", F.lit(as_of))
    return per.select(
        "customer", _elapsed_days(F.col("as_of"), F.col("last")).alias("recency_days"), _elapsed_days(F.col("as_of"), F.col("first")).alias("tenure_days"), "frequency", "monetary", "returned",
        (F.col("monetary") / F.greatest("frequency", F.lit(1))).alias("avg_order_value"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("returned") / F.greatest(F.abs("monetary"), F.lit(0.01)))).alias("return_rate"),
    )


def net_cents(ledger: DataFrame) -> DataFrame:
    """(customer, cents): net revenue of each customer to the cent, halves up.

    Lines are exact in ten-thousandths (prices and discounts have two digits), so sums do not depend on their order.
    """
    units = F.sum(F.round(F.col("revenue") * 10_000).cast("long"))
    return ledger.where("customer is not null").groupBy("customer").agg(F.floor((units + 50) / 100).alias("cents"))


def concentration(values: DataFrame, value: str) -> DataFrame:
    """The Lorenz curve from the largest value down: (value, customers, revenue) cumulative shares at each distinct value."""
    each = values.where(F.col(value) > 0).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    total = each.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("value")).alias("s"))
    run = running_totals(each, "value", {"c": F.col("k"), "r": F.col("k") * F.col("value")}, descending=True).crossJoin(F.broadcast(total))
    return run.select("value", (F.col("c") / F.col("n")).alias("customers"), (F.col("r") / F.col("s")).alias("revenue"))


def gini(values: DataFrame, value: str) -> DataFrame:
    """One row (gini, n): 0 if all positive values are equal; 0 without any."""
    each = values.where(F.col(value) > 0).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    run = running_totals(each, "value", {"c": F.col("k")})
    # Ranks of k equal values end at c: they sum to k (2c - k + 1) / 2.
    ranked = F.sum(F.col("k") * (2 * F.col("c") - F.col("k") + 1) / 2 * F.col("value"))
    figures = run.agg(ranked.alias("r"), F.sum(F.col("k") * F.col("value")).alias("s"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return figures.select(F.when(F.col("n") > 0, 2 * F.col("r") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"), "n")


def top_share(values: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, revenue): what the top ``share`` of customers bring, read at row int(share * n) - 1."""
    ranked = values.where(F.col(value) > 0).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    total = ranked.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("value")).alias("s"))
    run = running_totals(ranked, "value", {"c": F.col("k"), "r": F.col("k") * F.col("value")}, descending=True).crossJoin(F.broadcast(total))
    picks = values.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    row = F.greatest(F.floor(F.col("share") * F.col("n")), F.lit(1))
    found = run.crossJoin(F.broadcast(picks)).where((F.col("c") >= row) & (F.col("c") - F.col("k") < row))
    return found.select("share", ((F.col("r") - (F.col("c") - row) * F.col("value")) / F.col("s")).alias("revenue"))


def cohorts(ledger: DataFrame, *, zero_fill: bool = False) -> DataFrame:
    """(cohort, months_since, customers, rate, revenue) by month of first purchase.

    Cells in which a cohort bought nothing are 0, but only within the time observed; with ``zero_fill``
    also beyond it, up to the longest follow-up of any cohort.
    """
    rows = ledger.where("customer is not null").select("customer", "revenue", F.trunc(F.col("ts").cast("date"), "MM").alias("month"))
    monthly = rows.groupBy("customer", "month").agg(F.sum("revenue").alias("revenue"))
    monthly = monthly.withColumn("cohort", F.min("month").over(Window.partitionBy("customer")))
    months = lambda late, early: (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    cells = monthly.groupBy("cohort", months(F.col("month"), F.col("cohort")).alias("months_since")).agg(F.count("*").alias("customers"), F.sum("revenue").alias("revenue"))
    reach = rows.agg(F.max("month").alias("last"), F.min("month").alias("start"))
    intake = cells.where("months_since = 0").select("cohort", F.col("customers").alias("intake")).crossJoin(F.broadcast(reach))
    until = cells.agg(F.max("months_since").alias("most"))
    stop = F.col("most") if zero_fill else months(F.col("last"), F.col("cohort"))
    grid = intake.crossJoin(F.broadcast(until)).select("cohort", "intake", F.explode(F.sequence(F.lit(0), stop)).alias("months_since"))
    filled = grid.join(cells, ["cohort", "months_since"], "left")
    customers = F.coalesce("customers", F.lit(0))
    return filled.select("cohort", "months_since", customers.alias("customers"), (customers / F.col("intake")).alias("rate"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def average_survival(cells: DataFrame) -> DataFrame:
    """(months_since, rate): the mean rate over cohorts, each cohort counting once."""
    return cells.groupBy("months_since").agg(F.avg("rate").alias("rate"))


def one_time_buyers(customers: DataFrame) -> DataFrame:
    """One row (share): customers with one order."""
    return customers.agg(F.avg((F.col("frequency") == 1).cast("double")).alias("share"))


def value_at_risk(customers: DataFrame, *, dormant_days: int = 180) -> DataFrame:
    """Customers with two orders or more who have been quiet for ``dormant_days``."""
    return customers.where((F.col("recency_days") >= dormant_days) & (F.col("frequency") >= 2))
