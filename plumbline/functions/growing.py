"""Quantiles of a growing past: for each row of a series, of the values of all rows before it.

The k-th smallest value of a prefix is found by wavelet descent: at each bit of the values' ranks the number
of earlier rows on the lower side tells where to go on. A series of up to ``block`` rows is one descent. A
longer one is cut into blocks of time and ranges of values; counts by block and range, added up over time, are
the top of the descent, and each block goes on below in the ranges that its rows end in. So no task holds more
than a block and a range, however long the series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpointed, ship

#: Rows of a block of time, and about those of a range of values.
BLOCK = 1 << 16


class Wavelet:
    """Prefix counts of a sequence of codes by their bits, from the highest."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.bits, self.zeros = bits, []
        for b in range(bits - 1, -1, -1):
            low = (codes >> b) & 1 == 0
            self.zeros.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(low)]))
            codes = np.concatenate([codes[low], codes[~low]])

    def descend(self, upto: np.ndarray, k: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(code, rest): the code of the k-th smallest (from 0) of the first ``upto`` codes, and k less what is below that code.

        ``before`` are cumulative counts of codes that go ahead of the sequence (0, up to code 0, 1, ...).
        """
        low, high, k, code = np.zeros(len(upto), np.int64), upto.astype(np.int64), k.astype(np.int64), np.zeros(len(upto), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            a, b = zeros[low], zeros[high]
            left = b - a
            if before is not None:
                left = left + before[np.minimum(code + half, len(before) - 1)] - before[np.minimum(code, len(before) - 1)]
            right = k >= left
            k, code = np.where(right, k - left, k), np.where(right, code + half, code)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        return code, k


def places(n: np.ndarray, shares: list[float]) -> np.ndarray:
    """(shares, 2, rows): ranks between which the quantiles of the first n values lie (0 where there is none)."""
    at = np.maximum(n - 1, 0)[None, :] * np.array(shares)[:, None]
    low = np.floor(at).astype(np.int64)
    return np.stack([low, np.minimum(low + 1, np.maximum(n - 1, 0)[None, :])], axis=1)


def between(found: np.ndarray, n: np.ndarray, shares: list[float]) -> np.ndarray:
    """(shares, rows): interpolated quantiles from the values at ``places``; not a number without a past."""
    at = np.maximum(n - 1, 0)[None, :] * np.array(shares)[:, None]
    out = found[:, 0] + (found[:, 1] - found[:, 0]) * (at - np.floor(at))
    return np.where(n > 0, out, np.nan)


def prefix_quantiles(values: np.ndarray, shares: list[float]) -> np.ndarray:
    """(shares, rows): of the values before each one."""
    n = np.arange(len(values))
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = n
    tree, k = Wavelet(ranks, max(1, int(len(values) - 1).bit_length())), places(n, shares)
    code, _ = tree.descend(np.tile(n, k.shape[0] * 2), k.ravel())
    # Without a past the descent means nothing; any value will do, as the quantile is not a number.
    return between(values[order[np.minimum(code, len(values) - 1)]].reshape(k.shape), n, shares)


def _arrays(q: np.ndarray) -> pa.Array:
    return pa.array([None if np.isnan(row[0]) else row.tolist() for row in q.T], pa.list_(pa.float64()))


def expanding_quantiles(series: DataFrame, shares: list[float], *, block: int = BLOCK) -> DataFrame:
    """(series, idx, value, past, quantiles) of every row with a value: how many rows go before, and their quantiles.

    Rows of a series are in the order of ``idx``, which should be distinct; null series are one series; rows
    with a null idx or value are left out. Quantiles interpolate linearly and are null for the first row.
    """
    ship(series.sparkSession)
    rows = series.select(F.col("series").cast("string").alias("series"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).where("idx is not null and value is not null")
    sizes = rows.groupBy("series").agg(F.count("*").alias("n"))
    if not sizes.where(F.col("n") > block).limit(1).count():
        return _short(rows, shares)
    long_ = sizes.where(F.col("n") > block).select("series", F.lit(True).alias("_long"))  # one for each ``block`` rows at most
    rows = checkpointed(rows.join(long_.withColumnRenamed("series", "_s"), F.col("series").eqNullSafe(F.col("_s")), "left").select("series", "idx", "value", F.col("_long").isNotNull().alias("_long")))
    return _short(rows.where("not _long").drop("_long"), shares).unionByName(_long(rows.where("_long").drop("_long"), shares, block))


_OUT = "series string, idx long, value double, past long, quantiles array<double>"


def _short(rows: DataFrame, shares: list[float]) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        q = prefix_quantiles(table["value"].to_numpy(), shares)
        return table.append_column("past", pa.array(np.arange(len(table)))).append_column("quantiles", _arrays(q))

    return rows.groupBy("series").applyInArrow(run, _OUT)


def _long(rows: DataFrame, shares: list[float], block: int) -> DataFrame:
    """Blocks of time are equal counts of rows, ranges of values lie between approximate quantiles; each cut is a range of its own."""
    most = rows.groupBy("series").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]  # one number
    count = max(2, -(-most // block))
    grid = [i / count for i in range(1, count)]
    cuts = rows.groupBy("series").agg(F.array_distinct(F.percentile_approx("value", grid, 20 * count)).alias("cuts"), F.array_distinct(F.percentile_approx("idx", grid, 20 * count)).alias("starts"))

    def below(cuts: Column, x: Column, strict: bool) -> Column:
        """How many cuts lie below x (or at it), by halving: cuts ascend."""
        steps = F.array(*(F.lit(1 << k) for k in range(count.bit_length(), -1, -1)))
        inside = (lambda c: c < x) if strict else (lambda c: c <= x)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & inside(F.get(cuts, at + step - 1)), at + step).otherwise(at))

    on = F.col("series").eqNullSafe(F.col("_s"))
    placed = rows.join(cuts.withColumnRenamed("series", "_s"), on).drop("_s")
    under, upto = below(F.col("cuts"), F.col("value"), True), below(F.col("cuts"), F.col("value"), False)
    placed = checkpointed(placed.select("series", "idx", "value", below(F.col("starts"), F.col("idx"), False).alias("block"), (2 * under + F.when(upto > under, 1).otherwise(0)).alias("band")))
    each = placed.groupBy("series", "block", "band").agg(F.count("*").alias("n"))
    # What goes before a block: counts of all earlier blocks by band; one row for each block and band that any row has.
    blocks, bands = each.select("series", "block").distinct(), each.select("series", "band").distinct()
    cells = blocks.withColumnRenamed("series", "_s").join(bands, on).select("series", "block", "band")
    earlier = Window.partitionBy("series", "band").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = each.select(F.col("series").alias("_s"), F.col("block").alias("_b"), F.col("band").alias("_d"), "n")
    filled = cells.join(known, on & (F.col("block") == F.col("_b")) & (F.col("band") == F.col("_d")), "left").select("series", "block", "band", F.coalesce("n", F.lit(0)).alias("n"))
    before = filled.select(F.col("series").alias("in_series"), F.col("block").alias("in_block"), F.col("band").alias("band"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kinds = len(shares)

    def top(own: pa.Table, base: pa.Table) -> pa.Table:
        """Where in the bands each row's quantiles lie: (series, idx, value, past, ranks as band and rest)."""
        own, base = own.sort_by("idx"), base.sort_by("band")
        counts = np.zeros(int(max(base["band"].to_numpy().max(initial=0), own["band"].to_numpy().max(initial=0))) + 2, np.int64)
        counts[base["band"].to_numpy() + 1] = base["before"].to_numpy()
        ahead = np.cumsum(counts)
        band, at = own["band"].to_numpy().astype(np.int64), np.arange(len(own))
        past = ahead[-1] + at
        k = places(past, shares)
        tree = Wavelet(band, max(1, int(len(counts) - 2).bit_length()))
        code, rest = tree.descend(np.tile(at, kinds * 2), k.ravel(), ahead)
        wanted = [pa.array(list(x.reshape(kinds * 2, -1).T), pa.list_(pa.int64())) for x in (code, rest)]
        return pa.table([own["series"], own["block"], own["idx"], own["value"], pa.array(past), *wanted], names=["series", "block", "idx", "value", "past", "bands", "rests"])

    asked = placed.groupBy("series", "block").cogroup(before.groupBy("in_series", "in_block")).applyInArrow(top, "series string, block int, idx long, value double, past long, bands array<long>, rests array<long>")
    asked = checkpointed(asked)
    one = asked.select("series", "block", "idx", F.posexplode(F.arrays_zip("bands", "rests")).alias("at", "z")).select("series", "block", "idx", "at", F.col("z.bands").alias("band"), F.col("z.rests").alias("rest")).where("idx is not null")
    # A band of an odd number holds one value, its cut; the others are searched by the blocks that ask.
    flat = one.where("band % 2 = 1").withColumnRenamed("series", "_s").join(cuts, on).select("series", "idx", "at", F.get("cuts", ((F.col("band") - 1) / 2).cast("int")).alias("found"))
    deep = one.where("band % 2 = 0").withColumn("band", F.col("band").cast("int"))
    pairs = deep.select(F.col("series").alias("_s"), F.col("band").alias("_d"), F.col("block").alias("asking")).distinct()
    held = placed.where("band % 2 = 0").join(pairs, on & (F.col("band") == F.col("_d")) & (F.col("block") <= F.col("asking"))).select("series", "band", F.col("asking").alias("block"), "idx", "value")

    def search(questions: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("idx")
        values, at = items["value"].to_numpy(), items["idx"].to_numpy()
        order = np.argsort(values, kind="stable")
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        tree = Wavelet(ranks, max(1, int(len(values) - 1).bit_length()))
        code, _ = tree.descend(np.searchsorted(at, questions["idx"].to_numpy()), questions["rest"].to_numpy())
        found = values[order[np.minimum(code, len(values) - 1)]] if len(values) else np.full(len(questions), np.nan)
        return pa.table([questions["series"], questions["idx"], questions["at"], pa.array(found)], names=["series", "idx", "at", "found"])

    keys = ["series", "band", "block"]
    found = deep.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, "series string, idx long, at int, found double").unionByName(flat)
    gathered = found.groupBy("series", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "found"))), lambda s: s["found"]).alias("found"))  # two for each share
    spot = [(F.col("past") - 1) * F.lit(float(q)) for q in shares]
    quantiles = F.array(*(F.get("found", F.lit(2 * i)) + (F.get("found", F.lit(2 * i + 1)) - F.get("found", F.lit(2 * i))) * (p - F.floor(p)) for i, p in enumerate(spot)))
    gathered = gathered.select(F.col("series").alias("_s"), F.col("idx").alias("_i"), "found")
    joined = asked.join(gathered, on & (F.col("idx") == F.col("_i")))
    return joined.select("series", "idx", "value", "past", F.when(F.col("past") > 0, quantiles).alias("quantiles"))
