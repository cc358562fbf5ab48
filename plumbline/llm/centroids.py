"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to
each of the k centroids. After the centroids moved, the bounds move with them by the triangle inequality,
and only where they leave a doubt is a distance computed. Distances are exact integers; bounds are rounded
away from them and pruning is strict, so ties are always seen and go to the smaller number. A round is one
pass over the table of vectors and bounds: it writes the table of the next round and, for each task, what
the vectors that changed sides add to the sums of the clusters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T
from plumbline.llm.warc import open_folder, shared_folder

#: Components are cut to +-2**27, so that no squared distance of 64 components leaves a long.
MOST = 1 << 27


def above(squares: np.ndarray) -> np.ndarray:
    """Floats of 32 bits not below the roots of exact squares."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(squares: np.ndarray) -> np.ndarray:
    """Floats of 32 bits not above the roots of exact squares, 0 at least."""
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of int32 to a centroid of int64."""
    off = vectors - centre
    return np.einsum("ij,ij->i", off, off)


def between(centres: np.ndarray) -> np.ndarray:
    """(k, k): half the distance of two centroids, rounded down."""
    return np.stack([below(squared(centres, c)) for c in centres]) * np.float32(0.5)


def assign(vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, half: np.ndarray) -> int:
    """Move each vector to its nearest centroid, bounds in place; returns how many distances it took.

    A centroid is passed over where the upper bound lies strictly below its lower bound or strictly below
    half its distance from the own centroid: it is then farther away, so no tie is lost.
    """
    k, took = len(centres), 0
    others = np.where(np.eye(k, dtype=bool), np.float32(np.inf), half).min(axis=1)
    doubt = np.flatnonzero(~(upper < others[own]))
    if not len(doubt):
        return took
    v, a, low = vectors[doubt].astype(np.int64), own[doubt], lower[doubt]
    best = np.empty(len(doubt), np.int64)
    for c in range(k):  # the own distance, exact
        mine = np.flatnonzero(a == c)
        best[mine] = squared(v[mine], centres[c])
    took += len(doubt)
    up, rows = above(best), np.arange(len(doubt))
    low[rows, a] = below(best)
    for c in range(k):
        open_ = np.flatnonzero((a != c) & ~(up < half[a, c]) & ~(up < low[:, c]))
        d = squared(v[open_], centres[c])
        took += len(open_)
        low[open_, c] = below(d)
        nearer = (d < best[open_]) | ((d == best[open_]) & (c < a[open_]))
        to = open_[nearer]
        a[to], best[to] = c, d[nearer]
        up[to] = above(best[to])
    own[doubt], upper[doubt], lower[doubt] = a, up, low
    return took


def shift(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Loosen the bounds by how far (rounded up) each centroid moved, in place."""
    up, down = np.float32(np.inf), np.float32(-np.inf)
    still = moved == 0
    upper[:] = np.where(still[own], upper, np.nextafter(upper + moved[own], up))
    lower[:] = np.where(still, lower, np.maximum(np.nextafter(lower - moved, down), np.float32(0)))


def vectors_of(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly ``size`` finite components as integers floor(scale * x), others left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = (F.size(vector_col) == size) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return df.where(F.col(vector_col).isNotNull() & good).select(F.col(id_col).alias("id"), whole.alias("v"))


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    """Fixed-width binary values as a matrix of its own."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).copy()


def cluster_vectors(df: DataFrame, *, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors of another length, null vectors and those with a null, NaN or infinite component are left out;
    components beyond +-2**27 after scaling count as +-2**27. The first centroids are the ``k`` vectors with
    the least SHA-256 of ``seed:id`` (ties by components; null ids last); with fewer vectors there are fewer
    clusters. Repeated rows and null ids are vectors like others. Ties of distance go to the smaller number,
    an empty cluster keeps its centroid. Sums are longs: exact for fewer than 2**36 vectors at the bound.
    An empty table gives an empty result; other columns are ignored.

    The driver holds k centroids. Each round reads and writes the narrow table (integers and bounds) in
    tasks without a shuffle of vectors; the folder of the round before goes when the next one is written.
    When no vector changes sides, the rounds left would repeat the same centroids and are not run.
    """
    spark = df.sparkSession
    T.prepare(spark)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    source = vectors_of(df, id_col, vector_col, size, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = source.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).select("v").collect()
    centres = np.array([r["v"] for r in starts], np.int64).reshape(-1, size)
    names = f"id {kind}, v binary, own int, upper float, lower binary, n long, sums array<long>"
    folder, n = shared_folder(spark, "centroids"), len(centres)

    def step(centres: np.ndarray, moved: np.ndarray | None):
        """The pass of a round: bounds moved, vectors assigned, changes of counts and sums emitted at the end."""
        half = between(centres) if n else np.zeros((0, 0), np.float32)

        def run(batches):
            count, sums = np.zeros(n, np.int64), np.zeros((n, size), np.int64)
            for batch in batches:
                rows = batch.num_rows
                if moved is None:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size)
                    own, upper, lower = np.zeros(rows, np.int32), np.full(rows, np.inf, np.float32), np.zeros((rows, n), np.float32)
                    was = None
                else:
                    v, own = _rows(batch.column(1), np.int32, size), batch.column(2).to_numpy().copy()
                    upper, lower = batch.column(3).to_numpy().copy(), _rows(batch.column(4), np.float32, n)
                    was = own.copy()
                    shift(own, upper, lower, moved)
                assign(v, own, upper, lower, centres, half)
                changed = np.arange(rows) if was is None else np.flatnonzero(own != was)
                for sign, side in ((1, own), (-1, was)):
                    if side is not None:
                        count += sign * np.bincount(side[changed], minlength=n)
                        for c in np.unique(side[changed]):
                            sums[c] += sign * v[changed[side[changed] == c]].sum(axis=0, dtype=np.int64)
                none = pa.nulls(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(own), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))],
                    ["id", "v", "own", "upper", "lower", "n", "sums"],
                )
            told = np.flatnonzero(count.astype(bool) | sums.any(axis=1))
            if len(told):
                none = pa.nulls(len(told))
                yield pa.RecordBatch.from_arrays(
                    [none.cast(batch.column(0).type), none.cast(pa.binary()), pa.array(told.astype(np.int32)), none.cast(pa.float32()), none.cast(pa.binary()), pa.array(count[told]), pa.array(sums[told].tolist(), pa.list_(pa.int64()))],
                    ["id", "v", "own", "upper", "lower", "n", "sums"],
                )

        return run

    count, sums, moved, table = np.zeros(n, np.int64), np.zeros((n, size), np.int64), None, source
    for r in range(rounds + 1):
        table.mapInArrow(step(centres, moved), names).write.parquet(f"{folder}/{r}")
        written = spark.read.schema(names).parquet(f"{folder}/{r}")
        table = written.where("n is null").select("id", "v", "own", "upper", "lower")
        if r:
            files, where = open_folder(f"{folder}/{r - 1}")
            files.delete_dir(where)
        if r == rounds:
            break
        change = written.where("n is not null").groupBy("own").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size))).collect()
        for row in change:  # one for each cluster at most
            count[row["own"]] += row["n"]
            sums[row["own"]] += np.array([row[f"s{i}"] for i in range(size)], np.int64)
        new = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centres)
        if r and not change:
            break
        gone = squared(new, centres)
        moved, centres = np.where(gone == 0, np.float32(0), above(gone)), new
    return _result(spark, table, centres, kind, size).withColumnRenamed("id", id_col)


def _result(spark, table: DataFrame, centres: np.ndarray, kind: str, size: int) -> DataFrame:
    """Exact distances of the assigned vectors, with the sums of their clusters and of all."""

    def measure(batches):
        for batch in batches:
            v, own = _rows(batch.column(1), np.int32, size).astype(np.int64), batch.column(2)
            off = v - centres[own.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), own, pa.array(np.einsum("ij,ij->i", off, off))], ["id", "cluster", "distance"])

    found = table.select("id", "v", "own").mapInArrow(measure, f"id {kind}, cluster int, distance long")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    marks = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), marks[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
