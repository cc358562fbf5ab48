"""Running totals, positions, quantiles and curves over a global order without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a global order is cut into, at least.
RANGES = 32


def _ranges(df: DataFrame, ranges: int | None) -> int:
    """A power of two, no less than ``ranges`` or, without it, than the session's shuffle partitions."""
    return 1 << (max(ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 2) - 1).bit_length()


def with_range(df: DataFrame, key: Column, *, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of cuts below ``key``; cuts are approximate quantiles, one small array.

    Equal keys share a range, and a range holds about rows / ranges rows of distinct keys.
    """
    n = _ranges(df, ranges)
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(2000, 20 * n)).alias("_cuts"))
    steps = F.array(*(F.lit(n >> k) for k in range(1, n.bit_length())))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("_cuts"), at + step - 1) < key, at + step).otherwise(at))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", found).drop("_cuts")


def running_totals(df: DataFrame, key: str, sums: dict[str, Column], *, descending: bool = False, ranges: int | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with inclusive running totals of ``sums`` in the order of the numeric column ``key``, within ``groups``.

    Totals run within a range of keys (and a group), and the totals of the ranges before are added. Ranges
    are those of all groups together, so no window holds more than a range of the whole. Keys should be
    distinct in a group, else rows of equal keys get their totals in any order; aggregate by the key first.
    """
    k = -F.col(key) if descending else F.col(key)
    cut = with_range(df, k, ranges=ranges)
    per_range = cut.groupBy(*groups, "_range").agg(*(F.sum(e).alias(f"_{n}") for n, e in sums.items()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = per_range.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = Window.partitionBy(*groups, "_range").orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    on = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_g_{g}")), groups, F.col("_range") == F.col("_at"))
    out = cut.select("*", *(F.sum(e).over(own).alias(f"_r_{n}") for n, e in sums.items())).join(offsets if groups else F.broadcast(offsets), on)
    for n in sums:
        out = out.withColumn(n, F.col(f"_r_{n}") + F.col(f"_o_{n}")).drop(f"_r_{n}", f"_o_{n}")
    return out.drop("_range", "_at", *(f"_g_{g}" for g in groups))


def positions(df: DataFrame, key: Column, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the order of the numeric ``key``, then of ``order``."""
    cut = with_range(df, key)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(key, *order)))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_o") + F.col("_k") - 1).drop("_range", "_k", "_o")


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float], name: str = "cuts", *, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, ``name``: array of doubles): the linearly interpolated quantiles of the values that are not null, one row a group.
    A row may stand for ``weight`` (whole) rows.

    Values are counted first, and the counts run over ranges, so no task merges all distinct values, not even those of
    one group. Without ``groups`` there is one row, whose array is null if there are no values; a group without values has none.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    each = df.select(*groups, v.alias("_v"), *([F.col(weight).alias("_w")] if weight else [])).where("_v is not null").groupBy(*groups, "_v").agg((F.sum("_w") if weight else F.count("*")).alias("_n"))
    total = each.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    run = running_totals(each, "_v", {"_upto": F.col("_n")}, groups=groups)
    if groups:
        ends = total.select(*(F.col(g).alias(f"_t_{g}") for g in groups), "_all")
        run = run.join(ends, reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"_t_{g}")), groups, F.lit(True))).drop(*(f"_t_{g}" for g in groups))
    else:
        run = run.crossJoin(F.broadcast(total))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))

    place = [(F.col("_all") - 1) * F.lit(float(q)) for q in shares]
    row = run.groupBy(*groups).agg(F.max("_all").alias("_all"), *(at(F.floor(p)).alias(f"_l{i}") for i, p in enumerate(place)), *(at(F.ceil(p)).alias(f"_h{i}") for i, p in enumerate(place)))

    def between(i: int, p: Column) -> Column:
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return row.select(*groups, F.when(F.col("_all").isNotNull(), F.array(*(between(i, p) for i, p in enumerate(place)))).alias(name))


def trapezoid(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row (area): the area under the points in the order of x, then y; 0 without two points."""
    cut = with_range(points.select(F.col(x).alias("x"), F.col(y).alias("y")), F.col("x"))
    own = Window.partitionBy("_range").orderBy("x", "y")

    def step(x0: Column, y0: Column) -> Column:
        return (F.col("x") - x0) * (F.col("y") + y0) / 2

    inside = cut.select("_range", "x", "y", step(F.lag("x").over(own), F.lag("y").over(own)).alias("s"))
    # Ranges follow one another: the last point of one and the first of the next are neighbours.
    ends = inside.groupBy("_range").agg(F.sum("s").alias("s"), F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"))
    last = F.lag("b").over(Window.orderBy("_range"))  # one row for each range
    joined = ends.select("s", "a.x", "a.y", last.alias("b")).select("s", step(F.col("b.x"), F.col("b.y")).alias("t"))
    return joined.agg(F.coalesce(F.sum(F.coalesce("s", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))), F.lit(0.0)).alias("area"))
