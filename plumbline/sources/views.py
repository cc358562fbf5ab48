"""Logical views over the star schema: one definition of each data set that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.running import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines with customer and country; returns have negative quantity and revenue.

    The small dimension (nation) is left to the optimizer's broadcast threshold; lines, orders and
    customers are joined on their keys.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    is_return = F.col("l_returnflag") == "R"
    sign = F.when(is_return, -1.0).otherwise(1.0)
    return joined.select(
        F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("item"),
        F.col("o_orderdate").alias("ts"), is_return.alias("is_return"), (sign * F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.col("n_name").alias("country"),
    )


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``idx``, its position from 0 in a total order. For series that one task can hold."""
    return df.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, value, idx): order value of each day that has orders. One row a day, whatever the scale."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    return indexed(orders, "day")


def calendar(series: DataFrame, *, day: str = "day", value: str = "value") -> DataFrame:
    """(day, value, closed, open_idx): every day from the first to the last of ``series`` (one row a day at most), 0 where it has none.

    Days of value 0 are ``closed``; ``open_idx`` numbers the others from 0, null on closed days. A null day is left out
    and a null value counts as 0. The calendar is generated, one row a day, and joined to the series.
    """
    rows = series.where(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("day"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    ends = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).where("low is not null")
    days = ends.select(F.explode(F.sequence("low", "high")).alias("day"))
    filled = days.join(rows, "day", "left").select("day", F.coalesce("value", F.lit(0.0)).alias("value")).withColumn("closed", F.col("value") == 0)
    opened = F.sum((~F.col("closed")).cast("int")).over(Window.orderBy("day")) - 1  # a row a day
    return filled.withColumn("open_idx", F.when(~F.col("closed"), opened))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, value, x, idx): order value and order count of each month."""
    orders = table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.sum("o_totalprice").alias("value"), F.count("*").cast("double").alias("x"))
    return indexed(orders, "month")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score) of every line: whether it was returned, and a score with many ties."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("score"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score) of every rated document: good quality, and its share of the longest length."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    most = docs.agg(F.max("n_chars").alias("most"))
    joined = docs.join(labels, "doc_id").crossJoin(F.broadcast(most))
    return joined.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), (F.col("n_chars") / F.col("most")).alias("score"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, home, away, home_goals, away_goals, outcome 0..2): consecutive events paired in time order."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.floor(F.col("value") / 25).cast("int").alias("goals"))
    ordered = positions(events, F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"])
    halves = ordered.withColumn("m", (F.col("idx") / 2).cast("int")).groupBy("m").agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("user_id"))).alias("home"), F.max(F.when(F.col("idx") % 2 == 1, F.col("user_id"))).alias("away"),
        F.max(F.when(F.col("idx") % 2 == 0, F.col("goals"))).alias("home_goals"), F.max(F.when(F.col("idx") % 2 == 1, F.col("goals"))).alias("away_goals"),
    ).where("away is not null")
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), 0).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(2)
    return halves.withColumnRenamed("m", "idx").withColumn("outcome", outcome)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each customer: exposure, claims (returned lines, 4 at most), claim amount, and factors."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    span = orders.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    first = orders.groupBy("o_custkey").agg(F.min("d").alias("first"))
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")
    claims = returned.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("amount"))
    customers = table(spark, sf_dir, "customer")
    exposure = F.greatest(F.least(F.datediff("hi", "first") / F.datediff("hi", "lo"), F.lit(1.0)), F.lit(0.001))
    return (
        customers.join(first, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey").crossJoin(F.broadcast(span))
        .join(claims, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(F.col("c_custkey").alias("policy"), exposure.alias("exposure"), F.least(F.coalesce("n", F.lit(0)), F.lit(4)).cast("int").alias("claims"),
                F.coalesce("amount", F.lit(0.0)).alias("amount"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    )


def baskets(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """(basket, item) lines of invoices, with the part's brand, type or key as item."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part")
    if item == "p_partkey":
        return lines.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").cast("string").alias("item"))
    return lines.join(parts.select("p_partkey", item), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col(item).alias("item"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x): embeddings as arrays of doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
