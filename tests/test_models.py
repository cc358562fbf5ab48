"""Batched penalised fits, quantiles of a growing past, neighbours, state-space forecasts and tails."""

import math
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from plumbline.functions import growing, running, stats, tails
from plumbline.operators import batched, forecast, nearest, overlap, plugins, regimes, regularise, statespace
from plumbline.operators.calibration import logistic_scores
from pyspark import cloudpickle
from pyspark.sql import functions as F



def one(df):
    (row,) = df.collect()
    return row


# --- batched fits


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=1500)  # nearly a copy
    y = rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * x[:, 1] - 0.5)))
    rows = [(i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))] + [(None, None, 1.0, 1.0, 1.0, 1.0), (9999, 1.0, None, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, y double, a double, b double, c double, d double").checkpoint(), ["a", "b", "c", "d"]


def test_batched_fits_equal_single_ones_and_the_library(labelled, monkeypatch):
    rows, columns = labelled
    models = [regularise.penalty_model(p, 0.05) for p in ("none", "l2", "l1", "elasticnet")] + [batched.Model(f"r{r}", 0.02, 1.0, r) for r in range(5)]
    passes, sums = [], batched._sums
    monkeypatch.setattr(batched, "_sums", lambda *a, **b: passes.append(1) or sums(*a, **b))
    fits = batched.fit_all(rows, columns, models)
    assert len(passes) < 10
    for model, f in zip(models, fits, strict=True):
        assert np.allclose(batched.fit_all(rows, columns, [model])[0].beta, f.beta, atol=1e-6) and f.trail == sorted(f.trail, reverse=True)
    clean = rows.dropna()
    for f, (penalty, c) in zip(fits, [("none", 1.0), ("l2", 0.05), ("l1", 0.05), ("elasticnet", 0.05)], strict=False):
        _, model = logistic_scores(clean, clean, columns, penalty=penalty, c=c)
        assert np.allclose(f.beta[:-1], model.coefficients.toArray(), atol=2e-3) and abs(f.beta[-1] - model.intercept) < 2e-3
    assert 0 < fits[2].selected.sum() < 4


def test_draws_are_poisson_and_independent():
    keys = np.random.default_rng(0).integers(0, batched.PRIME, 50_000)
    w = batched.draw_weights(keys, [0, 1, 2, 57, None])
    assert np.allclose(w[:, :4].mean(axis=0), 1, atol=0.02) and np.allclose(w[:, :4].var(axis=0), 1, atol=0.03) and (w[:, 4] == 1).all()
    assert np.abs(np.corrcoef(w[:, :4].T) - np.eye(4)).max() < 0.02


def test_one_class_and_no_rows(spark):
    rows = spark.createDataFrame([(i, float(i == 3), float(i % 3)) for i in range(8)], "id long, y double, x double")
    fits = batched.fit_all(rows, ["x"], [batched.Model(str(r), 0.5, 1.0, r) for r in range(12)])  # many draws miss row 3 and are drawn again
    assert all(f.passes and np.isfinite(f.beta).all() for f in fits) and any(f.model.replicate >= 12 for f in fits)
    assert (batched.fit_all(rows.where("y = 0"), ["x"], [batched.Model("m")])[0].beta == 0).all()
    assert (batched.fit_all(rows.limit(0), ["x"], [batched.Model("m")])[0].beta == 0).all()


def test_path_and_stability(labelled):
    rows, columns = labelled
    path = regularise.regularisation_path(rows.dropna(), rows.dropna(), columns, strengths=[1e-4, 0.01, 1.0]).collect()
    assert len(path) == 12 and {r["selected"] for r in path if r["c"] == 1e-4} == {0} and max(r["test_auc"] for r in path) > 0.8
    fits = regularise.bootstrap_fits(rows, columns, c=0.01, replicates=30)
    found = {r["column"]: r for r in regularise.selection_frequency(rows.sparkSession, fits, columns).collect()}
    assert found["b"]["frequency"] == 1.0 and found["b"]["sign_consistency"] == 1.0 and found["c"]["frequency"] < 0.5


# --- a growing past


def test_quantiles_of_a_prefix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 65, 700):
        v = rng.integers(0, 9, n).astype(float)
        q = growing.prefix_quantiles(v, [0.0, 0.33, 0.8, 1.0])
        assert np.isnan(q[:, 0]).all() and all(np.allclose(q[:, i], np.quantile(v[:i], [0.0, 0.33, 0.8, 1.0])) for i in range(1, n))


def test_long_series_are_cut_and_equal_the_list(spark):
    rng = np.random.default_rng(4)
    series = {"ties": rng.integers(0, 4, 900).astype(float), "walk": np.cumsum(rng.normal(size=1200)), None: rng.normal(size=700), "flat": np.full(500, 2.0), "short": rng.normal(size=90), "one": np.zeros(1)}
    rows = [(s, i, float(x)) for s, v in series.items() for i, x in enumerate(v)] + [("short", 90, None)]
    df = spark.createDataFrame(rows, "series string, idx int, value double").repartition(7)
    for block in (64, 1 << 16):
        out = {(r["series"], r["idx"]): r for r in growing.expanding_quantiles(df, [0.33, 0.8], block=block).collect()}
        assert len(out) == len(rows) - 1
        for s, v in series.items():
            for i in range(len(v)):
                r = out[s, i]
                assert r["past"] == i and r["value"] == v[i]
                assert r["quantiles"] is None if i == 0 else np.allclose(r["quantiles"], np.quantile(v[:i], [0.33, 0.8]))
    labels = {(r["series"], r["idx"]): r["label"] for r in regimes.realtime_labels(df.where("series = 'walk'"), warmup=50).collect()}
    v = series["walk"]
    for i in range(len(v)):
        assert labels["walk", i] == (-1 if i < 50 else 2 if v[i] >= np.quantile(v[:i], 0.8) else 0 if v[i] <= np.quantile(v[:i], 0.33) else 1)
    assert growing.expanding_quantiles(df.limit(0), [0.5]).count() == 0


# --- neighbours


def plain_neighbours(x, k):
    d = np.round(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)), 9)
    out = {}
    for i in range(len(x)):
        near = sorted((d[i, j], j) for j in range(len(x)) if j != i)
        out[i] = near
    return {i: v[:k] for i, v in out.items()}, {(i, j): r for i, v in out.items() for r, (_, j) in enumerate(v)}


@pytest.mark.parametrize("shape", ["blobs", "grid", "copies", "few"])
def test_neighbours_are_those_of_all_pairs(spark, shape):
    rng = np.random.default_rng(6)
    x = {
        "blobs": np.concatenate([rng.normal(size=(80, 5)) + 40 * c for c in rng.normal(size=(10, 1, 5))]),
        "grid": np.array([(i, j) for i in range(20) for j in range(20)], float),
        "copies": np.concatenate([np.zeros((150, 3)), rng.normal(size=(100, 3))]),
        "few": rng.normal(size=(6, 2)),
    }[shape]
    k = 7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)], "id long, x array<double>").repartition(5)
    index = nearest.build(rows, block=40)
    found = {}
    for r in nearest.nearest(index, k).collect():
        found.setdefault(r["id"], []).append((r["r"], r["d"], r["other"]))
    expected, places = plain_neighbours(x, k)
    assert {i: [(d, j) for _, d, j in sorted(v)] for i, v in found.items()} == expected
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, len(x), (300, 2)) if a != b]
    got = {(r["id"], r["other"]): r["r"] for r in nearest.ranks(index, spark.createDataFrame(sorted(set(pairs)), "id long, other long")).collect()}
    assert got == {p: places[p] for p in set(pairs)}
    if shape == "blobs":
        visits = sum(r["n"] for r in nearest.nearest(index, k, visits=True).collect())
        assert visits < 0.3 * len(x) * len(index.cell) and len(index.cell) > 20 and index.size.sum() == len(x)


def test_index_of_nothing_and_string_ids(spark):
    none = spark.createDataFrame([], "id string, x array<double>")
    assert nearest.nearest(nearest.build(none), 3).count() == 0
    two = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "id string, x array<double>")
    assert [tuple(r) for r in nearest.nearest(nearest.build(two), 3).orderBy("id").collect()] == [("a", "b", 5.0, 1), ("b", "a", 5.0, 1)]


def test_copies_and_rows_of_many_blocks_need_bounded_memory(spark):
    """Candidates are measured some at a time, and a row goes to a page once, not to each block with its vector."""
    x, n = np.ones((3000, 64)), 3000
    held = nearest.Held(list(range(n)), x, np.zeros(n, int))
    zeros = pa.array(np.zeros(n, np.int32))
    part = pa.RecordBatch.from_arrays([zeros, zeros, zeros, zeros, pa.array(np.arange(n)), pa.array(list(x)), pa.array(np.full(n, np.inf))], names=["at", "salt", "asks", "block", "id", "x", "u"])
    tracemalloc.start()
    found = [r for b in nearest._closest(3, pa.int64())(held, part) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and {(r["id"], r["other"]) for r in found} == {(i, [j for j in range(4) if j != i][k]) for i in range(n) for k in range(3)}
    noise = np.random.default_rng(2).normal(size=(400, 64))  # no structure: every block may hold a neighbour
    index = nearest.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(noise)], "id long, x array<double>"), block=20)
    assert len(index.size) > 15 and index.pages.max() == 0


# --- state space and plug-ins


def dense_likelihood(y, phi, theta, lags=3000):
    """Log likelihood from the whole covariance matrix, by the weights of the infinite moving average."""
    psi = np.zeros(lags)
    psi[0] = 1
    for j in range(1, lags):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[k] * psi[j - 1 - k] for k in range(len(phi)) if j - 1 - k >= 0)
    cov = np.array([psi[: lags - h] @ psi[h:] for h in range(len(y))])[np.abs(np.subtract.outer(np.arange(len(y)), np.arange(len(y))))]
    scale = y @ np.linalg.solve(cov, y) / len(y)
    return -0.5 * (len(y) * math.log(2 * math.pi * scale) + np.linalg.slogdet(cov)[1] + len(y))


def test_filter_has_the_exact_likelihood_and_finds_planted_models():
    rng = np.random.default_rng(0)
    e, y = rng.normal(size=850), np.zeros(850)
    for t in range(2, 850):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + e[t] + 0.4 * e[t - 1]
    y = y[50:]
    for phi, theta in (([0.6, -0.3], [0.4]), ([0.9], [-0.5, 0.2]), ([], [0.7]), ([0.95], []), ([], [])):
        assert statespace.log_likelihood(y[:120], np.array(phi), np.array(theta)) == pytest.approx(dense_likelihood(y[:120], phi, theta), abs=1e-6)
    found = statespace.Arima((2, 0, 1)).fit(y + 5)
    assert np.allclose(found.phi, [0.6, -0.3], atol=0.12) and np.allclose(found.theta, [0.4], atol=0.12) and abs(found.mean - 5) < 0.3
    assert found.value == pytest.approx(dense_likelihood(y + 5 - found.mean, found.phi, found.theta), abs=1e-5)
    walk = statespace.Arima((1, 1, 1))
    assert np.isfinite(walk.forecast(np.cumsum(y[:200]), 6)).all() and (walk.forecast(np.ones(50), 3) == 1).all() and (walk.forecast(np.array([1.0, 2.0]), 2) == 2).all()
    assert np.allclose(statespace.coefficients(statespace.raw_of(np.array([0.6, -0.3, 0.1]))), [0.6, -0.3, 0.1])


def test_no_grid_point_beats_the_simplex():
    rng = np.random.default_rng(1)
    for series in (np.cumsum(rng.normal(size=60)) + 0.5 * np.arange(60), 10 + rng.normal(size=40)):
        fitted, z = statespace.Holt().fit(series), (series - series[0]) / np.std(series)
        grid = [statespace.Holt.start(z, a, a * b, f)[2] for a in np.linspace(0.02, 0.98, 9) for b in np.linspace(0.02, 0.98, 7) for f in np.linspace(0.81, 0.99, 5)]
        assert fitted.sse / np.var(series) <= min(grid) + 1e-9 and 0 < fitted.beta <= fitted.alpha < 1
    line = 3 + 2.0 * np.arange(30)
    assert statespace.Holt().forecast(line, 2)[0] == pytest.approx(line[-1] + 2, abs=0.3)
    rosenbrock = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    assert np.allclose(statespace.simplex(rosenbrock, np.array([-1.0, 2.0]))[0], [1, 1], atol=1e-4)


class Middle:
    """A user's forecaster: the median of the history."""

    name = "middle"

    def forecast(self, history, horizon):
        return np.repeat(np.median(history), horizon)


class FarFromMean:
    def fit_score(self, x):
        return np.abs(x - x.mean(axis=0)).sum(axis=1)


class Counts:
    def fit(self, categories, labels):
        self.known = {c: categories.count(c) for c in categories}

    def transform(self, categories):
        return np.array([self.known.get(c, 0) for c in categories])


def test_own_models_run_by_key(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
    values = [float(10 + (k * 7) % 5 + k / 10) for k in range(60)]
    series = spark.createDataFrame(list(enumerate(values)), "idx int, value double")
    scores = {r["model"]: r for r in forecast.evaluate(series, [30, 40, 50], horizon=5, season=1, models=("random_walk",), own=(Middle(),)).collect()}
    gap = [np.median(values[:o]) - np.array(values[o : o + 5]) for o in (30, 40, 50)]
    assert scores["middle"]["bias"] == pytest.approx(np.mean([g.mean() for g in gap])) and scores["middle"]["folds"] == scores["random_walk"]["folds"] == 3
    late = {r["model"]: r["bias"] for r in forecast.evaluate(series, [30], horizon=5, season=1, embargo=3, models=("random_walk",), own=(Middle(),)).collect()}
    assert late["middle"] == pytest.approx(np.median(values[:27]) - np.mean(values[30:35]))
    rows = [(k, f"{k}{i}", [float(i), float(i == 9) * 50]) for k in ("a", "b") for i in range(10)]
    found = plugins.detect(spark.createDataFrame(rows, "key string, id string, x array<double>"), FarFromMean())
    assert dict(found.dtypes)["id"] == "string" and {r["id"] for r in found.where("score > 40").collect()} == {"a9", "b9"}
    coded = spark.createDataFrame([("k", i, "train" if i < 6 else "test", "xy"[i % 2], 1.0) for i in range(9)] + [("k", 9, "test", "z", 0.0)], "key string, id int, split string, category string, y double")
    assert {r["id"]: r["encoded"] for r in plugins.encode(coded, Counts()).collect()} == {**dict.fromkeys(range(9), 3.0), 9: 0.0}
    with pytest.raises(Exception, match="finite values expected"):
        plugins.fold_forecasts(series, [30], 5, [type("Short", (Middle,), {"forecast": lambda s, h, n: [1.0]})()]).collect()


# --- tails


def test_tails_as_columns_are_those_of_single_figures(spark):
    rows = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 8.0, 40.0, -1.7) for df in (1.0, 2.0, 7.5, 30.0, 400.0, 1e5)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", "df", tails.student_two_sided(F.col("t"), F.col("df")).alias("p"), tails.normal_cdf(F.col("t")).alias("z"), tails.chi2_tail(F.abs("t")).alias("c"), tails.gamma_tail(F.col("df"), F.col("df") + F.col("t")).alias("g")).collect()
    for r in got:
        assert r["p"] == pytest.approx(stats.student_two_sided(r["t"], r["df"]), rel=1e-9, abs=1e-13)
        assert r["z"] == pytest.approx(stats.normal_cdf(r["t"]), rel=1e-9, abs=1e-14) and r["c"] == pytest.approx(stats.chi2_tail(abs(r["t"])), rel=1e-9, abs=1e-14)
    # Whole shapes: the tail of a gamma variable is a Poisson sum; an F variable of (2, m) has a closed form.
    for shape, x in ((1, 0.5), (3, 2.0), (12, 30.0), (40, 35.0)):
        exact = sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(shape))
        assert one(spark.range(1).select(tails.gamma_tail(F.lit(shape), F.lit(x)).alias("p")))["p"] == pytest.approx(exact, rel=1e-10)
    assert one(spark.range(1).select(tails.fisher_tail(3.0, 2, 10).alias("p")))["p"] == pytest.approx((1 + 2 * 3 / 10) ** -5, rel=1e-10)
    shares = [1e-9, 0.01, 0.3, 0.5, 0.7, 0.975, 1 - 1e-6]
    found = [r["z"] for r in spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0]], "p double").select(tails.normal_quantile(F.col("p")).alias("z")).collect()]
    assert found[-2:] == [None, None] and all(z == pytest.approx(stats.normal_ppf(p), abs=1e-8) for z, p in zip(found, shares, strict=False))
    lost = one(spark.createDataFrame([(None, 1.0)], "x double, s double").select(tails.gamma_tail(F.col("s"), F.col("x")).alias("g"), tails.student_two_sided(F.col("s"), F.col("x")).alias("t"), tails.beta_share(F.col("s"), F.col("s"), F.col("x")).alias("b")))
    assert tuple(lost) == (None, None, None)


def test_p_values_of_very_many_groups_are_one_plan(spark):
    rows = spark.range(100_000 * 5).select((F.col("id") / 5).cast("long").alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    found = one(overlap.slopes_by(rows, "g").agg(F.count("*").alias("n"), F.avg(F.col("significant").cast("double")).alias("s"), F.avg("p").alias("p")))
    assert found["n"] == 100_000 and abs(found["s"] - 0.05) < 0.005 and abs(found["p"] - 0.5) < 0.005


def test_quantiles_by_group_are_those_of_each(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=301), "b": rng.integers(0, 3, 200).astype(float), None: rng.normal(size=40), "one": np.array([5.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("lost", None)]
    got = {r["g"]: r["cuts"] for r in running.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.33, 0.8, 1.0], groups=("g",)).collect()}
    assert set(got) == set(groups) and all(np.allclose(got[g], np.quantile(v, [0.0, 0.33, 0.8, 1.0])) for g, v in groups.items())
    series = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)], "series string, idx int, value double")
    for r in regimes.hindsight_labels(series).collect():
        low, high = np.quantile(groups[r["series"]], [0.33, 0.8])
        assert r["label"] == (2 if r["value"] >= high else 0 if r["value"] <= low else 1)
