"""Anomaly detectors on (id, x: array) rows, and how far they agree. Scores grow with oddness."""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import running_totals
from plumbline.operators import nearest as N
from plumbline.operators.reduce import moments, second_moments
from plumbline.session import checkpointed, ship


def mahalanobis(rows: DataFrame) -> DataFrame:
    """(id, score): squared distance from the centre by the population covariance."""
    ship(rows.sparkSession)
    mean, _ = moments(rows)
    precision = np.linalg.pinv(second_moments(rows, mean, np.ones_like(mean)), hermitian=True)

    def score(batches):
        for batch in batches:
            z = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) - mean if batch.num_rows else np.zeros((0, len(mean)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(np.einsum("ij,jk,ik->i", z, precision, z))})

    return rows.select("id", "x").mapInArrow(score, f"id {dict(rows.dtypes)['id']}, score double")


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(rows: DataFrame, *, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """(id, score) in 0..1: random trees on hashed samples of ``sample`` rows each; rows meet all trees once.

    The forest has trees x sample nodes at most, whatever the number of rows, and is broadcast.
    """
    ship(rows.sparkSession)
    total = rows.count()
    draw = rows.select("id", "x").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 40)))
    share = min(1.0, 2.0 * sample / max(total, 1))
    picked = draw.where(F.col("h") < int(share * (1 << 40))).withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))).where(F.col("k") <= sample)

    def grow(x: np.ndarray, rng, limit: int) -> list:
        """A tree as nested (axis, cut, left, right), leaves as depth corrections."""
        if len(x) <= 1 or limit == 0 or not (x.max(axis=0) > x.min(axis=0)).any():
            return _path(len(x))
        axes = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
        axis = int(rng.choice(axes))
        cut = float(rng.uniform(x[:, axis].min(), x[:, axis].max()))
        left = x[:, axis] < cut
        return (axis, cut, grow(x[left], rng, limit - 1), grow(x[~left], rng, limit - 1))

    def plant(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for tree, i, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(tree, []).append((i, x))
        for tree, own in held.items():
            x = np.array([v for _, v in sorted(own)])
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "node": pa.array([pickle.dumps(grow(x, np.random.default_rng(seed * 7919 + tree), int(np.ceil(np.log2(max(len(x), 2))))))], pa.binary())})

    planted = picked.select(F.col("tree").cast("int").alias("tree"), "id", "x").repartition("tree").mapInArrow(plant, "tree int, node binary").orderBy("tree").collect()
    forest = rows.sparkSession.sparkContext.broadcast([pickle.loads(bytes(r["node"])) for r in planted])
    norm = _path(min(sample, total)) or 1.0

    def depths(node, x, at, depth, out):
        if not isinstance(node, tuple):
            out[at] += depth + node
            return
        axis, cut, left, right = node
        side = x[at, axis] < cut
        if side.any():
            depths(left, x, at[side], depth + 1, out)
        if not side.all():
            depths(right, x, at[~side], depth + 1, out)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            out = np.zeros(len(x))
            for tree in forest.value:
                depths(tree, x, np.arange(len(x)), 0, out)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(2.0 ** (-out / max(len(forest.value), 1) / norm))})

    return rows.select("id", "x").mapInArrow(score, f"id {dict(rows.dtypes)['id']}, score double")


def local_outlier_factor(rows: DataFrame, *, neighbours: int = 35) -> DataFrame:
    """(id, score): mean density of the nearest neighbours over one's own.

    Neighbours are found exactly by a metric index.
    """
    knn = checkpointed(N.nearest(N.build(rows), neighbours).select(F.col("id").alias("i"), F.col("other").alias("j"), "d"))
    reach = knn.groupBy("i").agg(F.max("d").alias("kd"))
    density = knn.join(reach.select(F.col("i").alias("j"), "kd"), "j").groupBy("i").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    around = knn.join(density.select(F.col("i").alias("j"), F.col("lrd").alias("their")), "j").groupBy("i").agg(F.avg("their").alias("their"))
    return around.join(density, "i").select(F.col("i").alias("id"), (F.col("their") / F.col("lrd")).alias("score"))


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k).select("id")


def top_k_overlap(a: DataFrame, b: DataFrame, *, k: int) -> DataFrame:
    """One row (overlap): the share of the k oddest rows that both name."""
    return _top(a, k).join(_top(b, k), "id").agg((F.count("*") / k).alias("overlap"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (rank_correlation) of ordinal ranks, ties broken by id."""

    def rank(s: DataFrame, name: str) -> DataFrame:
        """Ranks from the rows up to each score and the place among equal scores."""
        upto = running_totals(s.groupBy("score").agg(F.count("*").alias("_n")), "score", {"_upto": F.col("_n")})
        own = s.select("id", "score", F.row_number().over(Window.partitionBy("score").orderBy("id")).alias("_k"))
        return own.join(upto, "score").select("id", (F.col("_upto") - F.col("_n") + F.col("_k")).alias(name))

    return rank(a, "ra").join(rank(b, "rb"), "id").agg(F.corr("ra", "rb").alias("rank_correlation"))


def agreement_matrix(scores: dict[str, DataFrame], *, k: int) -> DataFrame:
    out = None
    for a, b in combinations(scores, 2):
        one = top_k_overlap(scores[a], scores[b], k=k).crossJoin(spearman(scores[a], scores[b])).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "overlap", "rank_correlation")
        out = one if out is None else out.unionByName(one)
    return out


def at_k(scores: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, precision, recall, lift) of labels (id, y) among the k oddest rows."""
    joined = scores.join(labels, "id")
    top = joined.orderBy(F.desc("score"), "id").limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    base = joined.agg(F.avg("y").alias("base"), F.sum("y").alias("positives"))
    picks = scores.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = F.broadcast(picks).join(top, F.col("r") <= F.col("k")).groupBy("k").agg(F.sum("y").alias("hits"))
    p = F.col("hits") / F.col("k")
    return hits.crossJoin(F.broadcast(base)).select("k", p.alias("precision"), (F.col("hits") / F.greatest("positives", F.lit(1))).alias("recall"), F.when(F.col("base") > 0, p / F.col("base")).otherwise(0.0).alias("lift"))
