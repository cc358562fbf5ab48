"""Ties, exact sums and steps whose work must not grow faster than the input."""

import time

import numpy as np
import pytest
from plumbline.functions import tails
from plumbline.operators import clusters, elo, ledger, metrics, pricing
from plumbline.plans import queries
from pyspark.sql import functions as F


def test_cents_do_not_depend_on_the_order_of_lines(spark):
    """1.005 is 1.01, though sums of its parts in floating point lie on either side of it."""
    lines = [("a", v) for v in (0.7, 0.1, 0.205)] + [("b", v) for v in (0.205, 0.1, 0.7)] + [("c", -0.005), ("d", 0.0149), (None, 5.0)]
    for parts in (1, 3):
        rows = spark.createDataFrame(lines, "customer string, revenue double").repartition(parts)
        assert {r["customer"]: r["cents"] for r in ledger.net_cents(rows).collect()} == {"a": 101, "b": 101, "c": 0, "d": 1}


def test_rules_of_equal_ratio_are_told_apart_by_name(spark):
    """Reversion looks at the slow length alone: rules of one slow length are equal but for the noise of their sums."""
    trials = spark.createDataFrame([("reversion(26,50)", 1.2000000000000004), ("reversion(10,50)", 1.2), ("momentum(2,10)", 1.1)], "rule string, sharpe_ann double")
    assert queries.best_rule(trials) == "reversion(10,50)"


def test_silhouette_is_that_of_all_pairs_without_a_row_a_pair(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(40, 3)), np.r_[rng.integers(0, 3, 39), 7]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(40):
        means = {g: d[i, (label == g) & (np.arange(40) != i)].mean() for g in set(label) if ((label == g) & (np.arange(40) != i)).any()}
        own, other = means.pop(label[i], None), min(means.values())
        scores.append(0.0 if own is None else (other - own) / max(own, other))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = clusters.silhouette(rows, spark.createDataFrame([(i, int(g)) for i, g in enumerate(label)], "id long, label int"))
    assert found.first()[0] == pytest.approx(np.mean(scores), abs=1e-12)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()


def test_a_new_season_costs_nothing_for_teams_that_do_not_play(spark):
    """Every match is its own season and has its own teams but for two: pulling all teams each time would be 10^9 steps."""
    n = 30_000
    rows = spark.range(n).select(F.lit("l").alias("league"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % (n - 1) == 0, -1).otherwise(2 * F.col("id")).alias("home"), (2 * F.col("id") + 1).alias("away"), F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"), F.col("id").alias("season"))
    began = time.monotonic()
    last = elo.walk_forward(rows, season="season").where(F.col("idx") == n - 1).first()
    assert last["home_rating"] == pytest.approx(1500, abs=1e-9) and time.monotonic() - began < 20


def test_tails_of_many_groups_are_columns_at_a_time(spark):
    rows = spark.range(200_000).select((F.col("id") % 50 / 10 - 2.5).alias("t"), (F.col("id") % 40 + 1).alias("df"))
    began = time.monotonic()
    found = rows.agg(F.sum(tails.student_two_sided(F.col("t"), F.col("df"))).alias("s"), F.count("*").alias("n")).first()
    assert 0.2 < found["s"] / found["n"] < 0.5 and time.monotonic() - began < 20
    one = spark.createDataFrame([(2.228138852, 10.0), (12.7062047, 1.0), (0.0, 3.0)], "t double, df double").select(tails.student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r["p"] for r in one] == pytest.approx([0.05, 0.05, 1.0], abs=1e-9)


def test_area_of_counted_rows_is_that_of_all_rows(spark):
    cells = [(0.1, 0.0, 3), (0.1, 1.0, 1), (0.5, 1.0, 4), (0.7, 0.0, 2), (0.9, 1.0, 5)]
    counted = spark.createDataFrame(cells, "score double, y double, n long")
    every = spark.createDataFrame([(s, y) for s, y, n in cells for _ in range(n)], "score double, y double")
    assert metrics.auc(counted, weight="n").first()["auc"] == pytest.approx(metrics.auc(every).first()["auc"], abs=1e-12)


def test_a_fit_makes_its_rows_once(spark, monkeypatch):
    """A reweighting reads what was written; rows that have to be joined again each time would be counted here."""
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"{'abc'[i % 3]}", i % 5 % 3, 1.0) for i in range(60)], "segment string, claims int, exposure double")
    pricing.fit_frequency(rows.mapInArrow(mark, rows.schema), ["segment"])
    assert made.value <= 2 * 60
