"""Many penalised logistic regressions over the same rows at once, by proximal Newton.

A model is a penalty and, for bootstrap replicates, a number from which each row's Poisson weight is drawn.
One pass over the rows adds up, for every model, the loss, the gradient and the weighted Gram matrix at its
coefficients; the driver then solves p x p problems with an l1 term. So the number of passes is the number of
Newton steps, whatever the number of models; models that are done take no part in later passes. Many replicates
start at the fit of all rows, from which they are a few steps away, and as long as models stand at the same
coefficients a row's terms are computed once for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpointed, ship

#: Prime modulus of the draws, and the multiplier and offset of replicate r modulo the prime. Fixed values.
PRIME = (1 << 31) - 1
STEP, OFFSET = 16_807, 48_271
#: Rows x models that a task works on at a time; few enough for a processor's cache.
CELLS = 1 << 16
PASSES = 40
#: Replicates from which on the passes of a fit of all rows, where they start, are worth it.
MANY = 16


@dataclass(frozen=True)
class Model:
    """Mean loss + 1/(c n) * (share * |b| + (1 - share)/2 * b^2), n the sum of weights; c infinite: no penalty."""

    name: str
    c: float = math.inf
    share: float = 1.0
    replicate: int | None = None


@dataclass
class Fit:
    """Coefficients (intercept last) of a model, the sum of its weights and how many passes it took."""

    model: Model
    beta: np.ndarray
    n: float = 0.0
    passes: int = 0
    trail: list[float] = field(default_factory=list)

    @property
    def selected(self) -> np.ndarray:
        return np.abs(self.beta[:-1]) > 1e-6


def row_key(identity: Column | str = "id") -> Column:
    """A number below the prime for each id, from its MD5."""
    c = F.col(identity) if isinstance(identity, str) else identity
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 12), 16, 10).cast("long"), F.lit(PRIME))


def poisson_cuts(most: int = 12) -> list[float]:
    """P(N <= k) of a Poisson variable of mean 1, k = 0, 1, ..."""
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += p
        out.append(total)
        p /= k
    return out


#: A weight is the number of cuts that a draw reaches.
CUTS = np.floor(np.array(poisson_cuts()) * PRIME).astype(np.uint32)


@lru_cache(maxsize=4)
def _maps(replicates: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the replicates' maps."""
    return tuple(np.array([pow(base, r + 1, PRIME) for r in replicates], np.int64) for base in (STEP, OFFSET))


def draw_weights(keys: np.ndarray, replicates: list[int | None]) -> np.ndarray:
    """(rows, models): Poisson(1) weights from an affine map of the key modulo the prime; 1 without a replicate."""
    drawn = [k for k, r in enumerate(replicates) if r is not None]
    if not drawn:
        return np.ones((len(keys), len(replicates)))
    a, b = _maps(tuple(replicates[k] for k in drawn))
    wide = keys[:, None] * a
    wide += b
    high = wide >> 31  # 2^31 is 1 modulo the prime
    wide &= PRIME
    wide += high
    v = wide.astype(np.uint32)
    top = v >> 31
    v &= PRIME
    v += top
    m = np.zeros(v.shape, np.uint8)
    for cut in CUTS:
        m += v >= cut
    m *= v != PRIME  # which is 0
    if len(drawn) == len(replicates):
        return m.astype(np.float64)
    out = np.ones((len(keys), len(replicates)))
    out[:, drawn] = m
    return out


def _sums(rows: DataFrame, fits: list[Fit], columns: int, gram: bool = True) -> dict[int, np.ndarray]:
    """For each model: sum of weights, of weights of y = 1, of losses, gradient and upper Gram matrix (or fitted sums), in one pass.

    Each task adds up its rows; the sums of a model then meet in one task, as numbers of fixed size. Models that
    stand at the same coefficients share a row's terms, and their sums are one product of weights and terms.
    """
    beta, replicates = np.stack([f.beta for f in fits], axis=1), [f.model.replicate for f in fits]
    upper, shared = np.triu_indices(columns + 1), len(fits) > 1 and bool((beta == beta[:, :1]).all())

    def add(batches):
        total = 0.0
        for block in _blocks(batches, columns):
            block = block[~np.isnan(block[:, 0])]  # a row without an id
            x = np.column_stack([block[:, 2:], np.ones(len(block))])
            y, keys = block[:, 1], block[:, 0].astype(np.int64)
            size = max(1, CELLS // len(fits))
            for a in range(0, len(y), size):
                own, label = x[a : a + size], y[a : a + size, None]
                m = draw_weights(keys[a : a + size], replicates)
                labelled = (own * label).T @ m
                plain = own.T @ m
                eta = own @ (beta[:, :1] if shared else beta)
                t = np.exp(-np.clip(eta, -700, 700))
                t += 1
                p = 1 / t
                np.log(t, out=t)  # the loss of a row is log(1 + exp(-eta)) + (1 - y) eta
                if eta.min(initial=0) < -700:
                    t += np.maximum(-eta - 700, 0)
                if shared:
                    fitted, losses = (own * p).T @ m, (t.T @ m)[0]
                    third = (own[:, upper[0]] * own[:, upper[1]] * (p * (1 - p))).T @ m if gram else fitted
                else:
                    losses = np.einsum("ij,ij->j", m, t)
                    m *= p
                    fitted = own.T @ m
                    p *= m
                    m -= p  # weight x p (1 - p)
                    third = (own[:, upper[0]] * own[:, upper[1]]).T @ m if gram else fitted
                parts = [plain[-1], labelled[-1], losses + (beta * (plain - labelled)).sum(axis=0), *(fitted - labelled), *third]
                total = total + np.stack(parts, axis=1)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"model": np.arange(len(fits), dtype=np.int32), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[k] = found.get(k, 0.0) + np.array(s)
        if found:
            yield pa.RecordBatch.from_pydict({"model": np.array(list(found), np.int32), "sums": pa.array(list(found.values()), pa.list_(pa.float64()))})

    schema = "model int, sums array<double>"
    return {r["model"]: np.array(r["sums"]) for r in rows.mapInArrow(add, schema).repartition("model").mapInArrow(merge, schema).collect()}  # a row for each model


def solve(gradient: np.ndarray, gram: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimisers of g.d + d.H.d/2 + l1 |b| + l2 b^2/2 at b = beta + d, for many models; the last one is not penalised.

    Coordinate descent over all models together finds the signs; the linear system of what is not 0 then
    gives the exact values where it keeps those signs.
    """
    q = beta.shape[1]
    diagonal = np.maximum(gram[:, range(q), range(q)], 1e-12)
    b, free = beta.copy(), np.zeros(q)
    free[-1] = 1.0
    slope = gradient.copy()  # of the quadratic part at b
    for _ in range(5000):
        most = 0.0
        for j in range(q):
            h = diagonal[:, j] + l2 * (1 - free[j])
            z = diagonal[:, j] * b[:, j] - slope[:, j]
            new = np.sign(z) * np.maximum(np.abs(z) - l1 * (1 - free[j]), 0) / h
            off = new - b[:, j]
            slope += gram[:, :, j] * off[:, None]
            b[:, j] = new
            most = max(most, float(np.abs(off).max(initial=0)))
        if most < 1e-13:
            break
    for k in range(len(b)):
        on = np.flatnonzero((b[k] != 0) | (free == 1))
        pull = l1[k] * np.sign(b[k]) * (1 - free)
        left = gram[k][np.ix_(on, on)] + np.diag(l2[k] * (1 - free[on]))
        right = gram[k][on] @ beta[k] - gradient[k][on] - pull[on]
        try:
            exact = np.linalg.solve(left, right)
        except np.linalg.LinAlgError:
            continue
        if (np.sign(exact) == np.sign(b[k][on]))[free[on] == 0].all():
            b[k, on] = exact
    return b


def _penalty(fit: Fit) -> tuple[float, float]:
    """(l1, l2) of the mean loss."""
    if math.isinf(fit.model.c):
        return 0.0, 0.0
    return fit.model.share / (fit.model.c * fit.n), (1 - fit.model.share) / (fit.model.c * fit.n)


def packed(rows: DataFrame, columns: list[str], *, y: str = "y", identity: Column | str = "id", draws: bool = True) -> DataFrame:
    """(block): the key (0 if nothing is drawn), label and columns of the rows whose label and columns are there, an Arrow batch of rows a block of doubles.

    A pass over many rows is then little more than its arithmetic.
    """
    ship(rows.sparkSession)
    own = F.col(identity) if isinstance(identity, str) else identity
    key = row_key(own) if draws else F.when(own.isNotNull(), F.lit(0))
    narrow = rows.select(key.cast("double").alias("_key"), F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double") for c in columns)).dropna(subset=["_y", *columns])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_pydict({"block": pa.array([block.tobytes()], pa.binary())})

    return narrow.mapInArrow(pack, "block binary")


def _blocks(batches, columns: int) -> Iterator[np.ndarray]:
    """(rows, key + label + columns) of each block."""
    for batch in batches:
        for value in batch.column(0):
            yield np.frombuffer(value.as_buffer(), np.float64).reshape(-1, columns + 2)


def narrowed(rows: DataFrame, columns: list[str], *, y: str = "y", identity: Column | str = "id", draws: bool = True) -> DataFrame:
    """The blocks of ``packed``, checkpointed; fits and areas read them."""
    return checkpointed(packed(rows, columns, y=y, identity=identity, draws=draws))


def fit_all(rows: DataFrame, columns: list[str], models: list[Model], *, y: str = "y", identity: Column | str = "id", tolerance: float = 1e-7) -> list[Fit]:
    """Fit every model on ``rows``; those with a null label, id or column are left out."""
    return fit_narrowed(narrowed(rows, columns, y=y, identity=identity, draws=any(m.replicate is not None for m in models)), columns, models, tolerance=tolerance)


def fit_narrowed(narrow: DataFrame, columns: list[str], models: list[Model], *, tolerance: float = 1e-7) -> list[Fit]:
    """Fit every model on rows that ``narrowed`` made; those with a null id are left out.

    Where there are many replicates, models of all rows are fitted first, and replicates start at the fit of their penalty. A replicate in which one
    class is missing is drawn again (its number grows by the number of models), so each counts. Without two classes
    in the rows the coefficients stay 0; without rows, too. What the driver holds is models x columns^2 numbers.
    """
    ship(narrow.sparkSession)
    if sum(m.replicate is not None for m in models) < MANY:
        return _newton(narrow, len(columns), [Fit(m, np.zeros(len(columns) + 1)) for m in models], len(models), tolerance)
    whole = [m for m in models if m.replicate is None]
    drawn = [m for m in models if m.replicate is not None]
    known = {(m.c, m.share) for m in whole}
    starts = [Model("start", c, share) for c, share in sorted({(m.c, m.share) for m in drawn} - known)]
    first = _newton(narrow, len(columns), [Fit(m, np.zeros(len(columns) + 1)) for m in whole + starts], len(models), tolerance)
    at = {(f.model.c, f.model.share): f.beta for f in first}
    later = _newton(narrow, len(columns), [Fit(m, at[m.c, m.share].copy()) for m in drawn], len(models), tolerance)
    a, b = iter(first), iter(later)
    return [next(a) if m.replicate is None else next(b) for m in models]


def _newton(narrow: DataFrame, q: int, fits: list[Fit], step_of_draws: int, tolerance: float) -> list[Fit]:
    """``fits`` moved from where they start to their optima."""
    open_, last, passes = list(range(len(fits))), {}, 0
    upper = np.triu_indices(q + 1)
    while open_ and passes < PASSES:
        passes += 1
        found = _sums(narrow, [fits[k] for k in open_], q)
        if not found:
            break
        step: list[int] = []
        for at, k in enumerate(open_):
            f, s = fits[k], found[at]
            if not 0 < s[1] < s[0]:
                if f.model.replicate is not None and passes < PASSES // 2:  # draw again
                    fits[k] = Fit(replace(f.model, replicate=f.model.replicate + step_of_draws), np.zeros(q + 1), passes=passes)
                continue
            f.n, f.passes = s[0], passes
            l1, l2 = _penalty(f)
            value = s[2] / s[0] + l1 * np.abs(f.beta[:-1]).sum() + l2 / 2 * (f.beta[:-1] ** 2).sum()
            if k in last and value > last[k][1] + 1e-13 * abs(last[k][1]):
                f.beta = (f.beta + last[k][0]) / 2  # too far: half the step
                continue
            last[k] = (f.beta.copy(), value)
            f.trail.append(value)
            step.append(at)
        if step:
            sums = np.stack([found[at] / found[at][0] for at in step])
            gram = np.zeros((len(step), q + 1, q + 1))
            gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = sums[:, 4 + q :]
            own = [fits[open_[at]] for at in step]
            beta, prices = np.stack([f.beta for f in own]), np.array([_penalty(f) for f in own])
            moved = solve(sums[:, 3 : 4 + q], gram, beta, prices[:, 0], prices[:, 1])
            for f, b in zip(own, moved, strict=True):
                f.beta = b
            done = {open_[at] for at, a, b in zip(step, beta, moved, strict=True) if np.abs(a - b).max() < tolerance * max(1.0, np.abs(b).max())}
        else:
            done = set()
        dead = {k for at, k in enumerate(open_) if not 0 < found[at][1] < found[at][0] and (fits[k].model.replicate is None or passes >= PASSES // 2)}
        open_ = [k for k in open_ if k not in done | dead]
    return fits


def moments(rows: DataFrame, columns: list[str], fits: list[Fit], *, y: str = "y", identity: Column | str = "id") -> DataFrame:
    """(model, column, moment): weighted sums of column x fitted probability plus the pull of the penalty.

    By the conditions of an optimum they equal the weighted sums of column x label: the pull of a coefficient
    that is not 0 follows from its sign and size, that of one at 0 is whatever is missing, l1 at most.
    """
    q = len(columns)
    narrow = packed(rows, columns, y=y, identity=identity, draws=any(f.model.replicate is not None for f in fits))
    found, out = _sums(narrow, fits, q, gram=False), []
    for k, s in found.items():
        f, (l1, l2) = fits[k], _penalty(fits[k])
        slope, moment = s[3 : 3 + q], s[4 + q :]
        pull = f.n * np.where(f.beta[:-1] != 0, l1 * np.sign(f.beta[:-1]) + l2 * f.beta[:-1], np.clip(-slope / f.n, -l1, l1))
        out += [(f.model.name, c, float(m)) for c, m in zip([*columns, "intercept"], moment + np.append(pull, 0.0), strict=True)]
    return rows.sparkSession.createDataFrame(out, "model string, column string, moment double")


#: Rows that a task sorts and counts at a time, rows of a range of scores, about, and rows for each one that places the cuts.
SENT_ROWS, RANGE_ROWS, THIN = 1 << 17, 1 << 19, 64


def areas(narrow: DataFrame, columns: list[str], fits: list[Fit], name: str = "auc", *, rows: int = RANGE_ROWS) -> DataFrame:
    """(model, ``name``): the area under the curve of every fit over rows that ``narrowed`` made; as ``metrics.auc``, of all fits at once.

    Scores are cut at approximate quantiles of each model (which decide balance alone) into ranges of about ``rows`` rows, so that equal
    scores share one. A task sends a range the scores it found, once each, with their rows and positives; what is between ranges follows from totals.
    """
    ship(narrow.sparkSession)
    q, betas = len(columns), [f.beta.tolist() for f in fits]
    total = (narrow.agg(F.sum(F.octet_length("block").cast("long"))).first()[0] or 0) // (8 * (q + 2))
    ranges = max(1, -(-total // rows))
    cuts: list[list[float]] = [[] for _ in fits]

    def score(block: np.ndarray, beta: list[float]) -> np.ndarray:
        """Log odds, added up column by column, so that equal rows have equal scores."""
        out = np.full(len(block), beta[-1])
        for j, b in enumerate(beta[:-1]):
            out += block[:, j + 2] * b
        return out

    def thin(batches):
        for block in _blocks(batches, q):
            for k, beta in enumerate(betas):
                own = np.sort(score(block, beta))
                own = own[min(THIN // 2, len(own) // 2) :: THIN]
                yield pa.RecordBatch.from_pydict({"model": np.full(len(own), k, np.int32), "score": own})

    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        places = narrow.mapInArrow(thin, "model int, score double").where("not isnan(score)").groupBy("model").agg(F.percentile_approx("score", shares, max(2000, 20 * ranges)).alias("cuts"))
        for r in places.collect():  # models x ranges
            cuts[r["model"]] = sorted(set(r["cuts"]))

    def send(held: list[np.ndarray]):
        block = np.concatenate(held)
        for k, beta in enumerate(betas):
            yield from _cells(k, np.array(cuts[k]), *_counted(score(block, beta), np.ones(len(block), np.int64), block[:, 1]))

    def count(batches):
        held, size = [], 0
        for block in _blocks(batches, q):
            held.append(block)
            size += len(block)
            if size >= SENT_ROWS:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def judge(key, table):
        flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("score", "n", "pos")]
        _, n, pos = _counted(*flat)
        own = n - pos
        below = np.cumsum(own) - own / 2
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "wins": [float((pos * below).sum())], "p": [float(pos.sum())], "m": [float(own.sum())]})

    each = narrow.mapInArrow(count, "model int, part int, score array<double>, n array<long>, pos array<double>").groupBy("model", "part").applyInArrow(judge, "model int, part int, wins double, p double, m double")
    before = Window.partitionBy("model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    run = each.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0.0)))
    sums = run.groupBy("model").agg(F.sum(F.col("wins") + F.col("p") * F.col("before")).alias("wins"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    names = narrow.sparkSession.createDataFrame([(k, f.model.name) for k, f in enumerate(fits)], "k int, name string")
    area = F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("wins") / (F.col("p") * F.col("m"))).otherwise(0.5)
    return sums.join(F.broadcast(names), F.col("model") == F.col("k")).select(F.col("name").alias("model"), area.alias(name))


def _counted(score: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order, with the sums of ``n`` and ``pos`` of each; scores that are not numbers are left out."""
    if np.isnan(score).any():
        real = ~np.isnan(score)
        score, n, pos = score[real], n[real], pos[real]
    order = np.argsort(score)
    score = score[order]
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])) if len(score) else np.zeros(0, np.int64)
    return score[first], np.add.reduceat(n[order], first) if len(first) else n[:0], np.add.reduceat(pos[order], first) if len(first) else pos[:0]


def _cells(model: int, cuts: np.ndarray, score: np.ndarray, n: np.ndarray, pos: np.ndarray):
    """A row for each range (a cut belongs to the range below it) that holds scores."""
    ends = np.concatenate([[0], np.searchsorted(score, cuts, side="right"), [len(score)]])
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        offsets = pa.array(np.append(ends[full], ends[full[-1] + 1]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (score, n, pos)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), model, np.int32)), pa.array(full.astype(np.int32)), *lists], ["model", "part", "score", "n", "pos"])
