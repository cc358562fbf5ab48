"""Association rules with a permutation null and a holdout. Lines are (basket, item)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles
from plumbline.operators.batched import OFFSET, PRIME, STEP, row_key
from plumbline.session import checkpointed, ship

#: Rows of a replicate that one window of the permutation holds, about.
BUCKET_ROWS = 50_000
#: Pairs of all items that one task counts, about.
PAIR_ROWS = 1 << 20
#: Names whose pairs a task of the permutation counts in an array; items of a basket beyond which its pairs go to other tasks, and of a block.
HELD, WIDE = 256, 1000
#: Cells (basket, item) of a bucket for each row up to which they are marked in an array; more are sorted.
DENSE = 64


def build_baskets(lines: DataFrame) -> DataFrame:
    """Distinct (basket, item) of baskets with two items or more."""
    distinct = lines.where("item is not null").select("basket", "item").distinct()
    return distinct.withColumn("size", F.count("*").over(Window.partitionBy("basket"))).where("size > 1")


def item_counts(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("item").agg(F.count("*").alias("n"))


def _top(baskets: DataFrame, n: int) -> DataFrame:
    """The n most frequent items (ties: by name); n rows at most."""
    return item_counts(baskets).orderBy(F.desc("n"), "item").limit(n)


def pair_counts(baskets: DataFrame, *, keep: DataFrame | None = None, max_basket: int | None = 60) -> DataFrame:
    """(a, b, n) with a < b of kept items; baskets with more than ``max_basket`` of them are skipped (the feature's limit; None: none).

    Pairs are made inside a basket's sorted item array, so no self join and no shuffle beyond the basket's. Pairs of kept items are
    few, and tasks add them up before they meet. Pairs of all items hardly repeat: their number is found first, and go to
    as many tasks as leave each about ``PAIR_ROWS`` to count, whatever the size of the table.
    """
    kept = baskets if keep is None else baskets.join(F.broadcast(keep.select("item")), "item", "left_semi")
    sets = kept.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items")).where((F.size("items") > 1) & (F.size("items") <= max_basket if max_basket else F.lit(True)))
    if keep is None:
        sets = checkpointed(sets.select("items"))
    first = sets.select("items", F.posexplode("items").alias("k", "a"))
    pairs = first.select("a", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("b"))
    if keep is None:
        total = sets.agg(F.sum((F.size("items") * (F.size("items") - 1) / 2).cast("long"))).first()[0] or 0
        pairs = pairs.repartition(max(-(-total // PAIR_ROWS), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def build_rules(baskets: DataFrame, *, min_support_count: int = 5, top_items: int = 400, max_basket: int | None = None) -> DataFrame:
    """Rules in both directions among the top items: support, confidence, lift, consequent support and leverage."""
    top = _top(baskets, top_items)
    total = baskets.select("basket").distinct().agg(F.count("*").alias("baskets"))
    pairs = pair_counts(baskets, keep=top, max_basket=max_basket).where(F.col("n") >= min_support_count)
    both = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n").unionByName(pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "n"))
    counts = lambda name, n: F.broadcast(top.select(F.col("item").alias(name), F.col("n").alias(n)))
    joined = both.join(counts("antecedent", "na"), "antecedent").join(counts("consequent", "nb"), "consequent").crossJoin(F.broadcast(total))
    n, na, nb, t = (F.col(c) for c in ("n", "na", "nb", "baskets"))
    return joined.select("antecedent", "consequent", n.alias("support_count"), (n / t).alias("support"), (n / na).alias("confidence"), (n / na / (nb / t)).alias("lift"), (nb / t).alias("consequent_support"), (n / t - na / t * (nb / t)).alias("leverage"))


def deal(keys: np.ndarray, codes: np.ndarray, owner: np.ndarray, replicate: int) -> tuple[np.ndarray, np.ndarray]:
    """(basket, item), in this order, of a bucket's rows with its pool of items dealt anew to the same slots, duplicates in a basket dropped.

    Rows are in the order of their slots; the pool is in the order of an affine map of the rows' keys modulo a prime.
    """
    a, b = pow(STEP, replicate + 1, PRIME), pow(OFFSET, replicate + 1, PRIME)
    drawn, bits = (keys * a + b) % PRIME, len(keys).bit_length()
    # Sorting numbers that end in the row's place is faster than sorting places by numbers; equal ones stay in order.
    places = np.sort(drawn << bits | np.arange(len(keys))) & ((1 << bits) - 1) if bits <= 32 else np.argsort(drawn, kind="stable")
    width = int(codes.max(initial=0)) + 1
    cells, top = owner * width + codes[places], (int(owner.max(initial=0)) + 1) * width
    if top > DENSE * max(1, len(keys)):
        return np.divmod(np.unique(cells), width)
    there = np.zeros(top, bool)
    there[cells] = True
    return np.divmod(np.flatnonzero(there), width)


def _buckets(batches):
    """(keys, names, codes, owner) of each bucket of sorted rows (bucket, key, basket, item): codes are places in the sorted names, owner numbers baskets."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
            if held and bucket[start] != last:
                yield _bucket(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = bucket[start]
    if held:
        yield _bucket(held)


def _bucket(held: list[pa.RecordBatch]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    keys, baskets, items = (pa.concat_arrays([batch.column(i) for batch in held]) for i in (1, 2, 3))
    found = items.dictionary_encode()
    names = found.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    code = np.empty(len(names), np.int64)
    code[order] = np.arange(len(names))
    own = baskets.dictionary_encode(null_encoding="encode").indices.to_numpy()
    owner = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
    return keys.to_numpy(), [names[k] for k in order], code[found.indices.to_numpy()], owner


def _pairs(own: np.ndarray, item: np.ndarray):
    """(a, b): the pairs of items of each basket, a before b, some of them at a time."""
    end, at, off, held = np.searchsorted(own, own, side="right"), np.arange(len(own)), 1, []
    while True:
        at = at[at + off < end[at]]
        held.append((item[at], item[at + off]))
        if not len(at) or sum(len(a) for a, _ in held) >= PAIR_ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
        if not len(at):
            return
        off += 1


def permutation_null(baskets: DataFrame, *, replicates: int = 20, min_support_count: int = 5, seed: int = 0) -> DataFrame:
    """(replicate, rules, max_lift, p99_lift, median_lift, share_over_2): what lift chance alone reaches, of all items and baskets.

    Items are dealt anew to slots of the same sizes within buckets of whole baskets, about ``BUCKET_ROWS`` rows
    each (small tables are one bucket), so a replicate needs no order of all rows. A task deals all replicates of
    its buckets and counts items and pairs: up to ``HELD`` names in arrays, more by bucket. Baskets of more than ``WIDE``
    items are cut into blocks of them, whose pairs are made by other tasks. Replicate r of seed s is draw 1000 s + r.
    """
    spark = baskets.sparkSession
    ship(spark)
    buckets = max(1, baskets.count() // BUCKET_ROWS)
    rows = baskets.select((row_key("basket") % buckets).alias("bucket"), row_key(F.concat_ws("/", F.col("basket").cast("string"), "item")).alias("key"), "basket", F.col("item").cast("string").alias("item"))
    rows = checkpointed(rows.repartition("bucket").sortWithinPartitions("bucket", "basket", "item"))
    held, wide = HELD, WIDE
    kinds = {"replicate": pa.int32(), "a": pa.string(), "b": pa.string(), "n": pa.int64(), "low": pa.list_(pa.string()), "high": pa.list_(pa.string())}

    def counted(r, n, a=None, b=None, low=None, high=None):
        columns = [np.full(len(n), r, np.int32), a, b, n, low, high]
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def told(number, alone, sums):
        """What the arrays of a task have counted."""
        names = np.array([*number, None], object)
        for r in range(replicates if number else 0):
            yield counted(r, alone[r, : len(number)], names[:-1])
            at = np.flatnonzero(sums[r])
            a, b = np.divmod(at, held)
            yield counted(r, sums[r][at], names[a], names[b])

    def count(batches):
        number: dict[str, int] = {}
        alone, sums, total = np.zeros((replicates, held), np.int64), np.zeros((replicates, held * held), np.int64), 0
        for keys, names, codes, owner in _buckets(batches):
            few, label = len(names) <= held, np.array(names, object)
            if few and len(number) + sum(n not in number for n in names) > held:
                yield from told(number, alone, sums)
                number = {}
                alone[:], sums[:] = 0, 0
            at = np.array([number.setdefault(n, len(number)) for n in names]) if few else None
            for r in range(replicates):
                own, item = deal(keys, codes, owner, 1000 * seed + r)
                singles = np.bincount(item, minlength=len(names))
                if few:
                    alone[r, at] += singles
                else:
                    yield counted(r, singles, label)
                size = np.bincount(own)
                for basket in np.flatnonzero(size > wide):  # names are sorted, so a basket's blocks are
                    one = label[item[own == basket]]
                    blocks = [one[k : k + wide].tolist() for k in range(0, len(one), wide)]
                    for i, low in enumerate(blocks):
                        yield counted(r, np.ones(len(blocks) - i, np.int64), low=[low] * (len(blocks) - i), high=blocks[i:])
                small = size[own] <= wide
                for a, b in _pairs(own[small], item[small]):
                    if few:
                        sums[r] += np.bincount(at[a] * held + at[b], minlength=held * held)
                    else:
                        pairs, n = np.unique(a * len(names) + b, return_counts=True)
                        a, b = np.divmod(pairs, len(names))
                        yield counted(r, n, label[a], label[b])
            total += int(owner[-1]) + 1  # a basket has a slot at least, so it has an item
        yield from told(number, alone, sums)
        for r in range(replicates if total else 0):
            yield counted(r, np.array([total]))

    found = checkpointed(rows.mapInArrow(count, "replicate int, a string, b string, n long, low array<string>, high array<string>"))
    blocks = found.where("low is not null").select("replicate", "low", "high").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    apart = blocks.select("replicate", F.explode("low").alias("a"), "high").select("replicate", "a", F.explode("high").alias("b"), F.lit(1).cast("long").alias("n")).where("a < b")
    pairs = found.where("b is not null").select("replicate", "a", "b", "n").unionByName(apart).groupBy("replicate", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support_count)
    single = found.where("a is not null and b is null").groupBy("replicate", "a").agg(F.sum("n").alias("na"))
    totals = found.where("a is null and low is null").groupBy("replicate").agg(F.sum("n").alias("baskets"))  # a row for each replicate
    joined = pairs.join(single, ["replicate", "a"]).join(single.select("replicate", F.col("a").alias("b"), F.col("na").alias("nb")), ["replicate", "b"]).join(F.broadcast(totals), "replicate")
    lift = checkpointed(joined.select("replicate", (F.col("n") * F.col("baskets") / (F.col("na") * F.col("nb"))).alias("lift")))
    # A pair is two rules of equal lift.
    figures = lift.groupBy("replicate").agg((2 * F.count("*")).alias("rules"), F.max("lift").alias("max_lift"), F.avg((F.col("lift") > 2).cast("double")).alias("share_over_2"))
    return figures.join(exact_quantiles(lift, "lift", [0.99, 0.5], groups=("replicate",)), "replicate").select("replicate", "rules", "max_lift", F.get("cuts", F.lit(0)).alias("p99_lift"), F.get("cuts", F.lit(1)).alias("median_lift"), "share_over_2")


def holdout_check(rules: DataFrame, later: DataFrame, *, top: int = 50) -> DataFrame:
    """The top rules by lift with lift and support in later baskets; held: a finite later lift over 1."""
    best = rules.orderBy(F.desc("lift"), "antecedent", "consequent").limit(top)
    total = later.select("basket").distinct().agg(F.count("*").alias("baskets"))
    counts = item_counts(later)
    wanted = F.broadcast(best.select("antecedent", "consequent"))
    a = later.select("basket", F.col("item").alias("antecedent")).join(wanted, "antecedent")
    joint = a.join(later.select("basket", F.col("item").alias("consequent")), ["basket", "consequent"]).groupBy("antecedent", "consequent").agg(F.count("*").alias("n"))
    joined = best.join(joint, ["antecedent", "consequent"], "left").join(counts.select(F.col("item").alias("antecedent"), F.col("n").alias("na")), "antecedent", "left").join(counts.select(F.col("item").alias("consequent"), F.col("n").alias("nb")), "consequent", "left").crossJoin(F.broadcast(total))
    later_lift = F.coalesce("n", F.lit(0)) * F.col("baskets") / (F.col("na") * F.col("nb"))
    return joined.select("antecedent", "consequent", "lift", F.coalesce("n", F.lit(0)).alias("later_count"), later_lift.alias("later_lift"), F.coalesce(later_lift > 1, F.lit(False)).alias("held"))


def shorten(column: str, width: int = 26):
    """Title case, cut to ``width`` with an ellipsis."""
    title = F.initcap(column)
    return F.when(F.char_length(title) > width, F.concat(F.substring(title, 1, width - 1), F.lit("…"))).otherwise(title)
