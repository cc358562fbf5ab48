"""Stability of k-means: agreement across seeds and samples against a shuffled null. Rows are (id, x: array)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.running import positions
from plumbline.operators.batched import row_key
from plumbline.session import checkpointed, ship

#: Rows whose distances to the centres of all fits are held at a time.
ROWS = 2048
#: Steps of a fit at most, and how far its centres may move in the last.
STEPS, TOLERANCE = 50, 1e-4


@dataclass(frozen=True)
class Fits:
    """Rows (id, key, x, part: which fits take the row, all if null) and the centres (fits x k x p) of several k-means fits of them."""

    rows: DataFrame
    centres: np.ndarray
    there: np.ndarray

    def labels(self) -> DataFrame:
        """(id, labels: one for each fit)."""
        centres, there, kind = self.centres, self.there, dict(self.rows.dtypes)["id"]

        def label(batches):
            for batch in batches:
                found = [own for _, _, own, _ in _nearest_centres(batch, centres, there)]
                if found:
                    each = np.concatenate(found).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * each.shape[1]), pa.array(each.ravel()))], names=["id", "labels"])

        return self.rows.mapInArrow(label, f"id {kind}, labels array<int>")

    def agreements(self, pairs: list[tuple[int, int]]) -> list[float | None]:
        """The adjusted Rand index of each pair of fits, on the rows of both: their labels are counted in one pass."""
        centres, there = self.centres, self.there
        k = centres.shape[1]

        def count(batches):
            cells = np.zeros((len(pairs), k * k), np.int64)
            for batch in batches:
                for _, _, own, part in _nearest_centres(batch, centres, there):
                    for c, (f, g) in enumerate(pairs):
                        both = part[:, f] & part[:, g]
                        cells[c] += np.bincount((own[:, f] * k + own[:, g])[both], minlength=k * k)
            yield pa.RecordBatch.from_pydict({"s": [cells.ravel().tolist()]})

        found = sum((np.array(r["s"]) for r in self.rows.mapInArrow(count, "s array<long>").collect()), np.zeros(len(pairs) * k * k, np.int64))  # a row for each task
        return [_index(cells) for cells in found.reshape(len(pairs), k, k)]


def _index(cells: np.ndarray) -> float | None:
    """The adjusted Rand index of a table of counts by both labels."""
    pairs = lambda c: float((c * (c - 1) / 2.0).sum())
    a, b, every = pairs(cells.sum(axis=1)), pairs(cells.sum(axis=0)), pairs(cells.sum())
    chance, most = (a * b / every if every else 0.0), (a + b) / 2
    return 1.0 if most == chance else (pairs(cells) - chance) / (most - chance)


def _nearest_centres(batch: pa.RecordBatch, centres: np.ndarray, there: np.ndarray):
    """(x, keys, the nearest centre of each fit, whether the fit takes the row) of some rows at a time."""
    fits, k, p = centres.shape
    flat, norms = centres.reshape(fits * k, p), np.where(there, (centres**2).sum(axis=2), np.inf)
    keys, x = batch.column(1).to_numpy(), np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
    taken = batch.column(3)
    part = np.ones((len(x), fits), bool) if taken.null_count == len(taken) else np.array(taken.flatten().to_numpy(zero_copy_only=False), bool).reshape(len(x), -1)
    for a in range(0, len(x), ROWS):
        some = x[a : a + ROWS]
        yield some, keys[a : a + ROWS], (norms - 2 * (some @ flat.T).reshape(-1, fits, k)).argmin(axis=2), part[a : a + ROWS]


def _draws(keys: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1) of the rows' keys (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _stacked(points: list[np.ndarray], p: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of each fit as one array, and which of its places are taken."""
    out, there = np.zeros((len(points), max(1, *(len(c) for c in points)), p)), np.zeros((len(points), max(1, *(len(c) for c in points))), bool)
    for f, c in enumerate(points):
        out[f, : len(c)], there[f, : len(c)] = c, True
    return out, there


def _start(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of weighted candidates: k-means++, then Lloyd's steps."""
    rng = np.random.default_rng(seed)
    chosen = points[:0]
    d = np.ones(len(points))
    while len(chosen) < k and (weight * d).sum() > 0:
        chosen = np.vstack([chosen, points[rng.choice(len(points), p=weight * d / (weight * d).sum())]])
        d = ((points[:, None] - chosen[None]) ** 2).sum(axis=2).min(axis=1)
    for _ in range(30 if len(chosen) else 0):
        own = ((points[:, None] - chosen[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(chosen)):
            if weight[own == c].sum() > 0:
                chosen[c] = np.average(points[own == c], axis=0, weights=weight[own == c])
    return chosen


def fit_centres(rows: DataFrame, k: int, seeds: list[int], *, part: Column | None = None) -> Fits:
    """k-means of all seeds, each from one initialisation (k-means|| of two rounds); ``part`` (array of booleans) tells which fits take a row.

    A step of all fits is one pass over the rows, which adds up what each fit's centres need: fits x k x p numbers a task.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    data = checkpointed(rows.where("x is not null").select("id", F.xxhash64("id").alias("key"), F.col("x").cast("array<double>").alias("x"), (F.lit(None).cast("array<boolean>") if part is None else part).alias("part")))
    p, fits = data.agg(F.max(F.size("x"))).first()[0] or 0, len(seeds)
    points = [np.zeros((0, p)) for _ in seeds]

    for round_, many in enumerate((1, 2 * k, 2 * k)):

        def draw(batches, round_=round_, many=many, points=points):
            """The rows of least -log(u) / d^2 of each fit: drawn without replacement, by their squared distance."""
            centres, there = _stacked(points, p)
            best = [(np.zeros(0), np.zeros((0, p))) for _ in seeds]
            for batch in batches:
                for x, keys, own, taken in _nearest_centres(batch, centres, there):
                    for f, seed in enumerate(seeds):
                        d = ((x - centres[f, own[:, f]]) ** 2).sum(axis=1) if round_ else np.ones(len(x))
                        ok = taken[:, f] & (d > 0)
                        score, where = np.r_[best[f][0], -np.log(_draws(keys[ok], seed, round_)) / d[ok]], np.vstack([best[f][1], x[ok]])
                        order = np.argsort(score, kind="stable")[:many]
                        best[f] = score[order], where[order]
            for f, (score, where) in enumerate(best):
                yield pa.RecordBatch.from_pydict({"fit": np.full(len(score), f, np.int32), "score": score, "x": pa.array(where.tolist(), pa.list_(pa.float64()))})

        found = data.mapInArrow(draw, "fit int, score double, x array<double>").withColumn("r", F.row_number().over(Window.partitionBy("fit").orderBy("score", "x"))).where(F.col("r") <= many).orderBy("fit", "r").collect()  # fits x 2k
        points = [np.vstack([c, *([r["x"] for r in found if r["fit"] == f] or [c[:0]])]) for f, c in enumerate(points)]

    def passed(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the rows nearest to each point of each fit."""
        centres, there = _stacked(points, p)
        many = centres.shape[1]

        def add(batches):
            sums = np.zeros((fits_ * many, p + 1))
            for batch in batches:
                for x, _, own, taken in _nearest_centres(batch, centres, there):
                    if len(active) < fits:
                        taken = taken[:, active] if taken.shape[1] == fits else taken
                    one = np.zeros((len(x), fits_ * many))
                    one[np.arange(len(x))[:, None], np.arange(fits_) * many + own] = taken
                    sums[:, :p] += one.T @ x
                    sums[:, p] += one.sum(axis=0)
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "s": [sums.ravel().tolist()]})

        fits_, active = len(points), open_
        found = data.mapInArrow(add, "task long, s array<double>").collect()  # a row for each task
        total = sum((np.array(r["s"]) for r in sorted(found, key=lambda r: r["task"])), np.zeros(fits_ * many * (p + 1))).reshape(fits_, many, p + 1)
        return total[:, :, :p], total[:, :, p]

    open_ = list(range(fits))
    _, weight = passed(points)
    points = [_start(c, w[: len(c)], k, seed) for c, w, seed in zip(points, weight, seeds, strict=True)]
    for _ in range(STEPS):
        if not open_:
            break
        sums, counts = passed([points[f] for f in open_])
        still = []
        for i, f in enumerate(open_):
            n = counts[i, : len(points[f]), None]
            new = np.where(n > 0, sums[i, : len(points[f])] / np.maximum(n, 1), points[f])
            if (((new - points[f]) ** 2).sum(axis=1) > TOLERANCE**2).any():
                still.append(f)
            points[f] = new
        open_ = still
    return Fits(data, *_stacked(points, p))


def fit_labels(rows: DataFrame, k: int, *, seed: int) -> DataFrame:
    """(id, label) by k-means from one initialisation."""
    return fit_centres(rows, k, [seed]).labels().select("id", F.get("labels", F.lit(0)).alias("label"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (ari) of two labellings (id, label), on the ids of both."""
    cells = a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id").groupBy("la", "lb").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = cells.agg(pairs(F.col("n")).alias("s"), F.sum("n").alias("t"))
    left = cells.groupBy("la").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("sa"))
    right = cells.groupBy("lb").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("sb"))
    every = F.col("t") * (F.col("t") - 1) / 2
    chance, most = F.col("sa") * F.col("sb") / every, (F.col("sa") + F.col("sb")) / 2
    return both.crossJoin(left).crossJoin(right).select(F.when(most == chance, 1.0).otherwise((F.col("s") - chance) / (most - chance)).alias("ari"))


def reseed_agreement(rows: DataFrame, k: int, *, seeds: int = 12) -> DataFrame:
    """(seed_a, seed_b, ari) for all pairs of seeds."""
    pairs = list(combinations(range(seeds), 2))
    found = fit_centres(rows, k, list(range(seeds))).agreements(pairs)
    return rows.sparkSession.createDataFrame([(*p, v) for p, v in zip(pairs, found, strict=True)], "seed_a int, seed_b int, ari double")


def resample_agreement(rows: DataFrame, k: int, *, rounds: int = 12, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """(round, ari) of fits on hashed samples against the fit on all rows."""
    part = F.array(F.lit(True), *(F.pmod(F.xxhash64("id", F.lit(seed + 1 + r)), F.lit(1000)) < int(1000 * fraction) for r in range(rounds)))
    found = fit_centres(rows, k, [seed + r for r in range(rounds + 1)], part=part).agreements([(0, r + 1) for r in range(rounds)])
    return rows.sparkSession.createDataFrame(list(enumerate(found)), "round int, ari double")


def shuffled_columns(rows: DataFrame, *, seed: int = 0) -> DataFrame:
    """(id, x) with each coordinate permuted on its own: the null of any structure between columns.

    Rows are put in a random order (MD5 of seed and id) once, over ranges; column k of p then comes from the row
    k n / p places further on, around the end. With n >= p no two columns move alike, and nothing is sorted by column.
    """
    n = rows.count()
    key = row_key(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(seed))))
    placed = checkpointed(positions(rows.select("id", "x", key.alias("_key")), F.col("_key"), ["id"], "_at").drop("_key"))
    each = placed.select("_at", F.size("x").alias("_p"), F.posexplode("x").alias("k", "v"))
    moved = each.select(F.pmod(F.col("_at") - F.floor(F.col("k") * F.lit(n) / F.col("_p")), F.lit(max(n, 1))).alias("_at"), "k", "v")
    dealt = moved.groupBy("_at").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("x"))  # the columns of one row
    return placed.select("id", "_at").join(dealt, "_at").select("id", "x")


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def silhouette(rows: DataFrame, labels: DataFrame, *, sample: int = 4000, seed: int = 0) -> DataFrame:
    """One row (silhouette): the mean Euclidean silhouette over at most ``sample`` rows of least hash.

    The pairs of a sample of fixed size are the measure's definition; the rows are otherwise untouched. The sample is
    broadcast, and each task takes the distances of some of its rows to all of it.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    part = rows.join(labels, "id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    part = checkpointed(part.select("x", F.col("label").cast("int").alias("label")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    held = part.collect()  # at most sample rows
    shared = spark.sparkContext.broadcast((np.array([r["x"] for r in held], np.float64), np.array([r["label"] for r in held], np.int64)))

    def score(batches):
        x, label = shared.value
        groups, code = np.unique(label, return_inverse=True)
        member = np.zeros((len(x), len(groups)))
        member[np.arange(len(x)), code] = 1.0
        count = member.sum(axis=0)
        for batch in batches:
            rows = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            own = np.searchsorted(groups, batch.column(1).to_numpy())
            out = np.zeros(len(rows))
            step = max(1, (1 << 22) // max(x.size, 1))
            for a in range(0, len(rows), step):
                d = np.sqrt(((rows[a : a + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ member  # a row is at 0 of itself
                at, mine = np.arange(len(d)), own[a : a + step]
                others = d / count
                others[at, mine] = np.inf
                near, inside = others.min(axis=1), d[at, mine] / np.maximum(count[mine] - 1, 1)
                most = np.maximum(near, inside)
                fit = (count[mine] > 1) & np.isfinite(near) & (most > 0)
                out[a : a + step][fit] = ((near - inside)[fit]) / most[fit]
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["s"])

    return part.select("x", "label").mapInArrow(score, "s double").agg(F.avg("s").alias("silhouette"))


def inertia_curve(rows: DataFrame, ks: list[int], *, starts: int = 4) -> DataFrame:
    """(k, inertia): the least within-cluster sum of squares of some starts."""
    data = rows.select(array_to_vector("x").alias("features")).cache()
    out = [(k, min(float(KMeans(k=k, seed=s, maxIter=50).fit(data).summary.trainingCost) for s in range(starts))) for k in ks]
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, inertia double")


def assess(rows: DataFrame, k: int, *, seeds: int = 12, rounds: int = 12, sample: int = 4000) -> DataFrame:
    """One row (k, silhouette, silhouette_on_shuffled, reseed_ari, resample_ari, beats_null, stable)."""
    rows = checkpointed(rows.select("id", "x"))
    real = silhouette(rows, fit_labels(rows, k, seed=0), sample=sample).first()[0]
    null_rows = checkpointed(shuffled_columns(rows))
    null = silhouette(null_rows, fit_labels(null_rows, k, seed=0), sample=sample).first()[0]
    again = reseed_agreement(rows, k, seeds=seeds).agg(F.median("ari")).first()[0]
    part = resample_agreement(rows, k, rounds=rounds).agg(F.median("ari")).first()[0]
    return rows.sparkSession.createDataFrame([(k, real, null, again, part, real > null, again >= 0.75 and part >= 0.75)], "k int, silhouette double, silhouette_on_shuffled double, reseed_ari double, resample_ari double, beats_null boolean, stable boolean")
