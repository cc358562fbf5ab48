"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0..G-1. One weight vector w is shared by all grades and G-1 ordered thresholds cut
the scale: P(grade <= j) = 1 / (1 + exp(w.x - t_j)). Features of a text are the distinct hashes of its
words, of their first and last bytes, and of coarse style figures. Training uses a bounded sample of
rated rows; selection uses the tail probability P(grade >= g) and gives the expected grade, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T

BITS = 18
#: Rated rows that training takes at most: those with the least hash of their id. Fixed and documented.
SAMPLE_ROWS = 10_000

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_PUNCTUATION = ~T.ALNUM & ~T.SPACES


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature indices of each text."""
    out: list[np.ndarray] = []
    for _, part in T.chunks(texts):
        hashes, counts = T.word_parts(part, ~T.SPACES, fold=True, prefixes=(3, 4, 5), suffixes=(3,))
        salted = [T.mix(h + np.uint64(k)) >> np.uint64(64 - BITS) for k, h in enumerate(hashes)]
        at = 0
        for data, n in zip(part, counts.tolist(), strict=True):
            own = [h[at : at + n] for h in salted]
            raw = np.frombuffer(data, np.uint8)
            kinds = len(np.unique(hashes[0][at : at + n]))
            style = [10 * kinds // max(n, 1), min(9, 20 * int(_UPPER[raw].sum()) // max(len(raw), 1)), min(9, 20 * int(_PUNCTUATION[raw].sum()) // max(len(raw), 1)), n.bit_length()]
            marks = T.mix(np.array([1000 * (k + 1) + v for k, v in enumerate(style)], np.uint64)) >> np.uint64(64 - BITS)
            out.append(np.unique(np.concatenate([*own, marks])).astype(np.int64))
            at += n
    return out


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, thresholds): log odds of a grade above each threshold."""
        z = np.array([self.weights[r].sum() for r in rows])
        return z[:, None] - self.thresholds[None, :]

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, thresholds): P(grade > j)."""
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, *, epochs: int = 15, rate: float = 0.1, penalty: float = 1e-3, least: int = 4, evidence: float = 3.0, seed: int = 0) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by AdaGrad over mini-batches.

    Features of fewer than ``least`` rows, and those whose mean grade is within ``evidence`` standard errors of
    the mean of all rows (fewer in samples so small that none could reach it), stay 0: else the many words
    that say nothing outweigh the few that do.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    seen, sums = np.zeros(size, np.int32), np.zeros(size)
    for r, grade in zip(rows, grades.tolist(), strict=True):
        seen[r] += 1  # indices of a row are distinct
        sums[r] += grade
    off = np.abs(sums - seen * grades.mean()) / np.sqrt(np.maximum(seen, 1)) / max(grades.std(), 1e-9)
    used_at_all = (seen >= least) & (off >= min(evidence, len(rows) ** 0.5 / 2))
    rows = [r[used_at_all[r]] for r in rows]
    w, w_sq = np.zeros(size), np.full(size, 1e-8)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels)) / len(grades), 0.01, 0.99)[:-1]
    t, t_sq = np.sort(np.log(share / (1 - share))), np.full(levels - 1, 1e-8)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            sizes = np.array([len(rows[i]) for i in batch])
            flat, own = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
            z, y, k = np.bincount(own, weights=w[flat], minlength=len(batch)), grades[batch], np.arange(len(batch))
            below = 1 / (1 + np.exp(np.clip(z[:, None] - t[None, :], -50, 50)))
            slope = np.pad(below * (1 - below), ((0, 0), (1, 1)))
            bounds = np.pad(below, ((0, 0), (1, 1)), constant_values=((0, 0), (0, 1)))
            p = np.maximum(bounds[k, y + 1] - bounds[k, y], 1e-12)
            up = (slope[k, y + 1] - slope[k, y]) / p
            pulled = np.bincount(flat, weights=up[own], minlength=size)
            used = np.flatnonzero(pulled)
            step = pulled[used] / len(batch) + penalty * w[used]
            w_sq[used] += step**2
            w[used] -= rate * step / np.sqrt(w_sq[used])
            pull = np.array([((slope[:, j + 1] / p) * ((y == j + 1).astype(float) - (y == j))).sum() for j in range(levels - 1)]) / len(batch)
            t_sq += pull**2
            t = np.sort(t - rate * pull / np.sqrt(t_sq))
    return OrdinalModel(w, t)


def train(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rated texts, those with the least hash of their id.

    Rows without a text, id or grade, and grades outside 0..levels-1, are not used; without any row all
    weights are 0 and every text gets the same probabilities. Texts of any length are used whole: a row of
    the sample is its distinct feature indices, at most 2**BITS of them.
    """
    T.prepare(docs.sparkSession)
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, levels - 1)).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    # The bound comes first: at most sample_rows ratings are ever joined with texts.
    rated = rated.withColumn("h", F.xxhash64(F.col("id"))).orderBy("h", "id", "grade").limit(sample_rows).select("id", "grade")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def extract(batches):
        for batch in batches:
            found = features(T.utf8(batch.column(2)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "grade": batch.column(1), "found": pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())})

    def learn(batches):
        """All sampled rows are one task: their number is bounded, and the driver only gets the weights."""
        rows = sorted({(i, g, f) for batch in batches for i, g, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
        if rows:
            model = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]), levels)
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype(np.float32).tobytes()], "thresholds": [model.thresholds.tolist()]})

    found = texts.join(F.broadcast(rated), "id").select("id", "grade", "text").mapInArrow(extract, "id string, grade int, found binary")
    learned = found.repartition(1).mapInArrow(learn, "weights binary, thresholds array<double>").collect()
    if not learned:
        return OrdinalModel(np.zeros(1 << BITS), np.zeros(levels - 1))
    return OrdinalModel(np.frombuffer(learned[0]["weights"], np.float32).astype(np.float64), np.array(learned[0]["thresholds"]))


def classify(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5, carry: bool = False) -> DataFrame:
    """(id, expected_grade, p_top, kept) of every row of ``docs``.

    ``p_top`` is the probability of the highest grade and ``kept`` is ``p_top >= accept``. Null and
    empty texts have no words and get what the thresholds and style features give. Repeated rows and
    null ids each get their row; an empty table gives an empty result; other columns are ignored, or with
    ``carry`` come along in a struct ``row`` of all columns of ``docs``, so that a selection needs no join.
    """
    T.prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 1 MiB: 2**BITS floats

    def score(batches):
        own = OrdinalModel(*shared.value)
        for batch in batches:
            tails = own.tails(features(T.utf8(batch.column(1))))
            own_columns = {"row": batch.column(2)} if carry else {}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "expected_grade": tails.sum(axis=1), "p_top": tails[:, -1], "kept": pa.array(tails[:, -1] >= accept)} | own_columns)

    row = [F.struct(*docs.columns).alias("row")] if carry else []
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row)
    schema = f"id {kind}, expected_grade double, p_top double, kept boolean" + (f", row {source.schema['row'].dataType.simpleString()}" if carry else "")
    return source.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 toxic, 1 of low quality, 2 of good quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))
