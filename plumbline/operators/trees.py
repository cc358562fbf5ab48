"""Boosted trees and forests of binned features, fitted and judged on counts.

Trees see a row's bins alone, so rows of equal bins are one cell, whatever the size of the table: the rows are read
once for the cuts and once to be counted, and every round, level and tree is an array operation over the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpointed, ship

#: Bins of a feature at most, and counts (cells by split, label and role) up to which one task fits a split.
BINS, CELLS = 32, 1 << 21


def cells(rows: DataFrame, features: list[str], splits: dict[str, Column]) -> DataFrame:
    """(split, codes, y, test, n): rows (label, features) counted by their bins; a split's column tells which rows are judged.

    Cuts are quantiles of the rows that are fitted; a bin holds the values up to its cut.
    """
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(F.when(~test, F.col(f)), shares, 10_000).alias(f"{s}/{f}") for s, test in splits.items() for f in features)).first()
    steps = []

    def code(f: str, cuts: list[float]) -> Column:
        held = F.array(*(F.lit(float(c)) for c in sorted(set(cuts))))
        return F.size(F.filter(held, lambda c: c < F.col(f)))

    for s, test in splits.items():
        steps.append(F.struct(F.lit(s).alias("split"), F.array(*(code(f, found[f"{s}/{f}"] or [0.0]) for f in features)).alias("codes"), test.alias("test")))
    each = rows.select(F.col("label").alias("y"), F.explode(F.array(*steps)).alias("c")).select("c.split", "c.codes", "y", "c.test")
    return checkpointed(each.groupBy("split", "codes", "y", "test").agg(F.count("*").alias("n")))


def grown(codes: np.ndarray, weight: np.ndarray, target: np.ndarray, depth: int, pick=None) -> np.ndarray:
    """The mean target of each cell's leaf: a node is cut where the sum of squares falls most; ``pick`` gives a mask (nodes x features) of those tried.

    ``target`` is the sum over a cell; cells without weight only follow the cuts.
    """
    node, nodes, rows = np.zeros(len(codes), np.int64), 1, np.arange(len(codes))
    for _ in range(depth):
        best, feature, cut = np.full(nodes, 1e-12), np.full(nodes, -1), np.zeros(nodes, np.int64)
        tried = np.ones((nodes, codes.shape[1]), bool) if pick is None else pick(nodes)
        for f in range(codes.shape[1]):
            at = node * BINS + codes[:, f]
            w, t = (np.bincount(at, v, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for v in (weight, target))
            all_w, all_t, w, t = w[:, -1:], t[:, -1:], w[:, :-1], t[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = t**2 / w + (all_t - t) ** 2 / (all_w - w) - all_t**2 / all_w
            gain[~((w > 0) & (all_w - w > 0)) | ~tried[:, [f]]] = -np.inf
            most = gain.argmax(axis=1)
            gain = gain[np.arange(nodes), most]
            fit = gain > best
            best[fit], feature[fit], cut[fit] = gain[fit], f, most[fit]
        own = feature[node]
        node = 2 * node + ((own >= 0) & (codes[rows, own] > cut[node]))
        nodes *= 2
    w, t = np.bincount(node, weight, nodes), np.bincount(node, target, nodes)
    return np.divide(t, w, out=np.zeros(nodes), where=w > 0)[node]


def boosted(codes: np.ndarray, negative: np.ndarray, positive: np.ndarray, *, rounds: int = 250, depth: int = 3, rate: float = 0.1) -> np.ndarray:
    """Each cell's probability by gradient boosting of the logistic loss (labels -1 and 1; the first tree counts whole, as in Spark's)."""
    margin = grown(codes, negative + positive, positive - negative, depth)
    for _ in range(rounds - 1):
        pull = positive * 4 / (1 + np.exp(2 * margin)) - negative * 4 / (1 + np.exp(-2 * margin))
        margin = margin + rate * grown(codes, negative + positive, pull, depth)
    return 1 / (1 + np.exp(-2 * margin))


def forest(codes: np.ndarray, negative: np.ndarray, positive: np.ndarray, *, trees: int = 250, depth: int = 4, seed: int = 1) -> np.ndarray:
    """Each cell's mean share of positives over bootstrapped trees, which try the root of the features' number at a node.

    A row's Poisson weights add up to a Poisson number of the cell's rows, so counts are drawn as rows would be.
    """
    rng, p = np.random.default_rng(seed), codes.shape[1]
    few, total = max(1, int(np.ceil(np.sqrt(p)))), np.zeros(len(codes))
    for _ in range(trees):
        one, zero = rng.poisson(positive).astype(float), rng.poisson(negative).astype(float)
        total += grown(codes, one + zero, one, depth, lambda nodes: rng.random((nodes, p)).argsort(axis=1) < few)
    return total / trees


def scores(counts: DataFrame, *, rounds: int = 250, trees: int = 250) -> DataFrame:
    """(split, model, score, y, n) of the judged rows of ``cells``: a task fits a split."""
    ship(counts.sparkSession)

    def fit(key, table):
        codes, own = np.unique(np.array(table["codes"].combine_chunks().flatten()).reshape(table.num_rows, -1), axis=0, return_inverse=True)
        own, y, test, n = own.ravel(), table["y"].to_numpy() > 0.5, table["test"].to_numpy(), table["n"].to_numpy().astype(float)
        negative, positive = (np.bincount(own, n * (~test & (y == v)), len(codes)) for v in (False, True))
        out = []
        for name, score in (("boosted", boosted(codes, negative, positive, rounds=rounds)), ("forest", forest(codes, negative, positive, trees=trees))):
            out.append(pa.table({"split": pa.array([key[0].as_py()] * int(test.sum())), "model": pa.array([name] * int(test.sum())), "score": score[own][test], "y": y[test].astype(float), "n": n[test].astype(np.int64)}))
        return pa.concat_tables(out)

    return counts.groupBy("split").applyInArrow(fit, "split string, model string, score double, y double, n long")
