"""Price elasticities pooled, within product, and within product and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.overlap import ols


def product_month_panel(ledger: DataFrame, *, min_months: int = 6) -> DataFrame:
    """(item, month, units, revenue, price, log_units, log_price) of purchases; the price is revenue over units."""
    sold = ledger.where(~F.col("is_return") & (F.col("quantity") > 0)).groupBy("item", F.trunc(F.col("ts").cast("date"), "MM").alias("month"))
    panel = sold.agg(F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue")).where("units > 0").withColumn("price", F.col("revenue") / F.col("units")).where("price > 0")
    panel = panel.withColumn("months", F.count("*").over(Window.partitionBy("item"))).where(F.col("months") >= min_months)
    return panel.withColumn("log_units", F.log("units")).withColumn("log_price", F.log("price"))


def _estimate(frame: DataFrame, method: str) -> DataFrame:
    return frame.agg(*ols(), F.countDistinct("item").alias("items")).select(F.lit(method).alias("method"), F.col("slope").alias("elasticity"), "se", "n", "items")


def naive_elasticity(panel: DataFrame) -> DataFrame:
    return _estimate(panel.select("item", F.col("log_price").alias("x"), F.col("log_units").alias("y")), "pooled")


def within_product(panel: DataFrame) -> DataFrame:
    own = Window.partitionBy("item")
    demeaned = panel.select("item", (F.col("log_price") - F.avg("log_price").over(own)).alias("x"), (F.col("log_units") - F.avg("log_units").over(own)).alias("y"))
    return _estimate(demeaned, "within product")


def within_product_and_month(panel: DataFrame) -> DataFrame:
    """One pass: less the means of product and month, plus the mean of all."""
    own, month = Window.partitionBy("item"), panel.groupBy("month").agg(F.avg("log_price").alias("mp"), F.avg("log_units").alias("mu"))
    total = panel.agg(F.avg("log_price").alias("ap"), F.avg("log_units").alias("au"))
    frame = panel.withColumn("op", F.avg("log_price").over(own)).withColumn("ou", F.avg("log_units").over(own)).join(month, "month").crossJoin(F.broadcast(total))
    demeaned = frame.select("item", (F.col("log_price") - F.col("op") - F.col("mp") + F.col("ap")).alias("x"), (F.col("log_units") - F.col("ou") - F.col("mu") + F.col("au")).alias("y"))
    return _estimate(demeaned, "within product and month")


def per_product(panel: DataFrame, *, min_months: int = 10) -> DataFrame:
    """(item, elasticity, se, months) of products with enough months and some spread of price."""
    rows = panel.select("item", F.col("log_price").alias("x"), F.col("log_units").alias("y"))
    fits = rows.groupBy("item").agg(*ols(), F.stddev_samp("x").alias("spread"))
    return fits.where((F.col("n") >= min_months) & (F.col("spread") >= 1e-9)).select("item", F.col("slope").alias("elasticity"), "se", F.col("n").alias("months"))
