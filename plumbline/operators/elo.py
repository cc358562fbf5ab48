"""Ratings updated match by match, forecasts from odds, and scores of three-way forecasts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship


def expected_home(home_rating: Column, away_rating: Column, advantage: float = 65.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home_rating + advantage - away_rating) / 400))


def three_way(expected: Column, draw_rate: float = 0.25) -> Column:
    """array(home, draw, away): the draw at its base rate, the rest shared by the expectation."""
    rest = 1.0 - draw_rate
    share = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (expected - draw_rate / 2) / rest))
    return F.array(rest * share, F.lit(float(draw_rate)), rest * (1 - share))


def walk_forward(matches: DataFrame, *, k: float = 20.0, advantage: float = 65.0, start: float = 1500.0, margin_factor: float = 0.35, season: str | None = None, regress: float = 0.25) -> DataFrame:
    """(league, idx, home_rating, away_rating, expected): ratings before each match, in the order of idx.

    Ratings depend on all matches before, so a league is one sequential fold; leagues run in parallel.
    ``season`` names a column whose change pulls all ratings by ``regress`` towards the start; a team's are pulled when it
    plays next, once for each change since, so a change costs nothing for teams that do not play.
    """
    ship(matches.sparkSession)
    named = matches.select("league", "idx", F.col("home").cast("string").alias("home"), F.col("away").cast("string").alias("away"), "home_goals", "away_goals", (F.col(season).cast("string") if season else F.lit("")).alias("season"))

    def fold(batches):
        ratings: dict[str, tuple[float, int]] = {}  # rating and the number of changes it has seen
        league = now = None
        changes = 0

        def rating(team: str) -> float:
            r, seen = ratings.get(team, (start, changes))
            for _ in range(changes - seen):
                pulled = r + regress * (start - r)
                if pulled == r:  # as near to the start as it gets
                    break
                r = pulled
            return r

        for batch in batches:
            out: list[tuple] = []
            for name, idx, home, away, hg, ag, term in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if name != league:
                    league, now, changes, ratings = name, term, 0, {}
                if term != now:
                    now, changes = term, changes + 1
                h, a = rating(home), rating(away)
                expected = 1 / (1 + 10 ** (-(h + advantage - a) / 400))
                actual = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
                step = k * (1 + margin_factor * math.log1p(abs(hg - ag))) * (actual - expected)
                ratings[home] = h + step, changes
                ratings[away] = rating(away) - step, changes
                out.append((name, idx, h, a, expected))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["league", "idx", "home_rating", "away_rating", "expected"])

    return named.repartition("league").sortWithinPartitions("league", "idx").mapInArrow(fold, "league string, idx int, home_rating double, away_rating double, expected double")


def implied_probabilities(odds: Column) -> Column:
    """Inverse odds over their sum."""
    raw = F.transform(odds, lambda o: 1 / o)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def overround(odds: Column) -> Column:
    return F.aggregate(F.transform(odds, lambda o: 1 / o), F.lit(0.0), lambda a, x: a + x)


def forecast_scores(forecasts: DataFrame, *, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, brier, log_loss, accuracy, n) of rows (p: array, outcome: index); the first largest is the call."""
    p, y = F.col("p"), F.col("outcome")
    squares = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == y).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    picked = F.get(p, y)
    return forecasts.groupBy(*groups).agg(
        F.avg(squares).alias("brier"), (-F.avg(F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), picked))))).alias("log_loss"),
        F.avg((F.array_position("p", F.array_max("p")) - 1 == y).cast("double")).alias("accuracy"), F.count("*").alias("n"),
    )


def pooled_reliability(forecasts: DataFrame, *, bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n) over all pairs of match and outcome."""
    from plumbline.operators.metrics import calibration_curve

    pairs = forecasts.select("outcome", F.posexplode("p").alias("k", "score")).select("score", (F.col("k") == F.col("outcome")).cast("int").alias("y"))
    return calibration_curve(pairs, bins=bins)


def betting_roi(bets: DataFrame, pick: Column, *, only: Column | None = None) -> DataFrame:
    """One row (bets, profit, roi) of unit stakes on the picked outcome at the given odds."""
    rows = bets.withColumn("_pick", pick)
    rows = rows if only is None else rows.where(only)
    pnl = F.when(F.col("_pick") == F.col("outcome"), F.get("odds", F.col("_pick")) - 1).otherwise(-1.0)
    return rows.agg(F.count("*").alias("bets"), F.sum(pnl).alias("profit"), F.avg(pnl).alias("roi"))
