"""Whole results of steps that were cut or too slow on larger tables."""

from collections import Counter
from hashlib import md5
from itertools import combinations

import numpy as np
from plumbline.operators import basket, clusters, recommend, reduce, trees
from plumbline.operators.batched import OFFSET, PRIME, STEP
from plumbline.plans import model_queries, queries  # noqa: F401
from pyspark.sql import functions as F


def test_als_of_few_items_is_a_pass_a_step(spark):
    """The same recommendations as normal equations of whole matrices; Spark's ALS took several jobs a step."""
    rng = np.random.default_rng(3)
    has = (rng.random((80, 25)) < np.where(np.arange(25) % 2 == np.arange(80)[:, None] % 2, 0.4, 0.1)).astype(float)
    has[:, 7] = 0
    has[0, 7] = has[has.sum(axis=1) == 0, 3] = 1
    pairs = [(int(u), f"i{i:02d}") for u, i in zip(*np.nonzero(has), strict=True)]
    train = spark.createDataFrame([*pairs, *pairs[:50]], "user long, item string").repartition(5)
    users = spark.createDataFrame([(u,) for u in [*range(0, 80, 2), 999]], "user long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("als-of-few", "")
    found = recommend.als(train, users, factors=4, iterations=6, seed=2, k=5).collect()
    jobs = len(tracker.getJobIdsForGroup("als-of-few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    y = np.random.default_rng(2).standard_normal((25, 4))
    y /= np.linalg.norm(y, axis=1, keepdims=True)

    def side(r, other):
        return np.stack([np.linalg.solve(other.T @ other + 20 * other[row > 0].T @ other[row > 0] + 0.05 * row.sum() * np.eye(4), 21 * row @ other) for row in r])

    for _ in range(6):
        y = side(has.T, side(has, y))
    scores = np.where(has > 0, -np.inf, side(has, y) @ y.T)
    wanted = {(u, f"i{i:02d}", k) for u in range(0, 80, 2) for k, i in enumerate(np.argsort(-scores[u], kind="stable")[:5])}
    assert {tuple(r) for r in found} == wanted and jobs < 45, jobs


def test_distances_of_all_pairs_are_correlated(spark, monkeypatch):
    """More rows than the sample of 600 that was taken before, over several groups and blocks, with copies and rows without a vector."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6)) * [3, 1, 1, 1, 1, 0.1] + 50
    x[700:720] = x[5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, x array<double>")
    flat = rows.select("id", F.slice("x", 2, 3).alias("x"))
    pairs = np.triu_indices(900, 1)
    full, cut = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))[pairs] for v in (x, x[:, 1:4]))
    wanted = np.corrcoef(full, cut)[0, 1]
    assert abs(reduce.pairwise_distance_corr(rows, flat).first()[0] - wanted) < 1e-12
    monkeypatch.setattr(reduce.N, "PAGE", 2000)  # five groups
    assert abs(reduce.pairwise_distance_corr(rows, flat).first()[0] - wanted) < 1e-12
    assert reduce.pairwise_distance_corr(rows.limit(1), flat).first()[0] is None
    same = rows.where("id >= 700 and id < 720")
    assert reduce.pairwise_distance_corr(same, same).first()[0] is None


def test_ranks_tell_the_overlap(spark, monkeypatch):
    """Both measures from one search, with ties, over several pages."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 5)), 1)
    x[100:130] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    flat = rows.select("id", F.slice("x", 1, 2).alias("x"))
    monkeypatch.setattr(reduce.N, "PAGE", 1500)
    monkeypatch.setattr(reduce.N, "BLOCK", 50)
    order = []
    for v in (x, x[:, :2]):
        d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), 9)
        np.fill_diagonal(d, np.inf)
        order.append(np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1))
    near = order[1] < 12
    trust = 1 - 2 / (700 * 12 * (1400 - 37)) * np.maximum(order[0] - 12, 0)[near].sum()
    found = reduce.neighbourhoods_kept(rows, flat).first()
    assert abs(found["trustworthiness"] - trust) < 1e-9 and abs(found["overlap"] - (order[0][near] < 12).mean()) < 1e-9


def test_random_items_are_drawn_from_all(spark, monkeypatch):
    """Every unseen item can be drawn; before, a user was offered only the first places of one order."""
    train = spark.createDataFrame([(u, f"i{i}") for u in range(40) for i in range(60) if (u + i) % 7 == 0], "user long, item string")
    users = spark.createDataFrame([(u,) for u in range(45)], "user long")
    wanted = set()
    for u in range(45):
        unseen = [f"i{i}" for i in range(60) if u >= 40 or (u + i) % 7]
        best = sorted(unseen, key=lambda i: (-int(md5(f"{u}/{i}/0".encode()).hexdigest()[:8], 16), i))[:4]
        wanted |= {(u, i, k) for k, i in enumerate(best)}
    found = {tuple(r) for r in recommend.random_items(train, users, k=4).collect()}
    assert found == wanted and len({i for _, i, _ in found}) > 50
    monkeypatch.setattr(recommend, "DRAWN", 20)
    assert {tuple(r) for r in recommend.random_items(train, users, k=4).collect()} == wanted


def test_the_null_takes_all_items_and_baskets(spark, monkeypatch):
    """More than 400 items, and a basket of more than 60: both were cut before."""
    rng = np.random.default_rng(8)
    rows = [(b, f"i{i:03d}") for b in range(300) for i in rng.choice(40, 5, replace=False)] + [(300, f"i{i:03d}") for i in range(500)] + [(b, f"i{i:03d}") for b in range(301, 311) for i in range(b % 2, 90, 2)]
    baskets = spark.createDataFrame(sorted(set(rows)), "basket long, item string")
    own = sorted(set(rows))
    key = lambda text: int(md5(text.encode()).hexdigest()[:12], 16) % PRIME
    wanted = {}
    for r in range(2):
        drawn = sorted(own, key=lambda s: ((key(f"{s[0]}/{s[1]}") * pow(STEP, r + 1, PRIME) + pow(OFFSET, r + 1, PRIME)) % PRIME, *s))
        sets: dict[int, set] = {}
        for (b, _), (_, item) in zip(own, drawn, strict=True):
            sets.setdefault(b, set()).add(item)
        alone, pairs = Counter(i for s in sets.values() for i in s), Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
        lifts = [n * len(sets) / (alone[a] * alone[b]) for (a, b), n in pairs.items() if n >= 5]
        wanted[r] = (2 * len(lifts), max(lifts), np.quantile(lifts, 0.99), np.quantile(lifts, 0.5), np.mean(np.array(lifts) > 2))
    for name, value in (("HELD", 256), ("HELD", 600), ("WIDE", 30)):
        monkeypatch.setattr(basket, name, value)
        found = {r[0]: tuple(r)[1:] for r in basket.permutation_null(basket.build_baskets(baskets), replicates=2).collect()}
        assert found.keys() == wanted.keys() and all(np.allclose(found[r], wanted[r], atol=1e-12) for r in wanted)


def test_rules_of_large_baskets(spark):
    """As the query's SQL has it, a basket of more than 60 items counts, too."""
    baskets = spark.createDataFrame([(b, f"i{i:03d}") for b in range(6) for i in range(70)], "basket long, item string")
    assert basket.build_rules(basket.build_baskets(baskets)).count() == 70 * 69


def test_all_fits_take_one_pass_a_step(spark):
    """Spark's k-means took several jobs a step of each fit, and labels of all fits were joined by id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4)) + 6 * rng.integers(0, 3, (500, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "")
    found = {(r["seed_a"], r["seed_b"]): r["ari"] for r in clusters.reseed_agreement(rows, 5, seeds=4).collect()}
    jobs = len(tracker.getJobIdsForGroup("fits"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    fits = clusters.fit_centres(rows, 5, [0, 1, 2, 3])
    labels = {r["id"]: r["labels"] for r in fits.labels().collect()}
    for f in range(4):
        own = np.array([labels[i][f] for i in range(500)])
        assert np.allclose(fits.centres[f], [x[own == c].mean(axis=0) for c in range(5)], atol=1e-3)  # a fixed point
        assert (((x[:, None] - fits.centres[f]) ** 2).sum(axis=2).argmin(axis=1) == own).all()
    table = lambda f: spark.createDataFrame([(i, v[f]) for i, v in labels.items()], "id long, label int")
    assert len(found) == 6 and abs(found[1, 3] - clusters.adjusted_rand(table(1), table(3)).first()[0]) < 1e-12 and jobs < 75, jobs
    part = clusters.resample_agreement(rows, 3, rounds=2).collect()
    assert [r["round"] for r in part] == [0, 1] and all(r["ari"] > 0.9 for r in part)
    assert clusters.fit_labels(rows.limit(2), 5, seed=0).count() == 2 and clusters.fit_labels(rows.limit(0), 5, seed=0).count() == 0


def test_trees_of_counts_are_those_of_rows(spark):
    """A cell of n rows counts n times, and 250 rounds find what 5 of depth 3 do not."""
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 4, (2000, 4))
    y = rng.random(2000) < 1 / (1 + np.exp(-1.5 * (codes - 1.5) @ [1, -1, 0.5, 0.25]))
    cells, own = np.unique(codes, axis=0, return_inverse=True)
    own = own.ravel()
    counted = [np.bincount(own, y == v, len(cells)).astype(float) for v in (False, True)]
    whole = trees.boosted(codes, (~y).astype(float), y.astype(float), rounds=30)
    assert np.allclose(trees.boosted(cells, *counted, rounds=30)[own], whole, atol=1e-9)
    loss = lambda p: -np.where(y, np.log(p), np.log(1 - p)).mean()
    assert loss(trees.boosted(cells, *counted)[own]) < loss(trees.boosted(cells, *counted, rounds=5)[own]) - 0.01
    assert loss(trees.forest(cells, *counted)[own]) < 0.6


def test_tree_models_take_all_rounds(spark):
    rows = spark.createDataFrame([(float(i % 3 == 0), float(i % 7), float(i % 3), i % 5) for i in range(600)], "label double, a double, b double, part int")
    found = trees.scores(trees.cells(rows, ["a", "b"], {"random": F.col("part") == 4}))
    rows = found.collect()
    assert sum(r["n"] for r in rows) == 240 and {r["model"] for r in rows} == {"boosted", "forest"}
    assert all((r["score"] > 0.5) == (r["y"] > 0.5) for r in rows if r["model"] == "boosted")
    assert trees.scores.__kwdefaults__ == {"rounds": 250, "trees": 250}
