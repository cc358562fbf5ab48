"""Recommenders on (user, item) rows and their ranking metrics. Recommendations are (user, item, rank) from 0."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.running import exact_quantiles
from plumbline.session import checkpointed, ship

#: Items of a user that meet in one row when pairs are made.
ITEM_BLOCK = 500
#: Items up to which a factorisation adds up a matrix of factors x factors for each of them in a task.
FEW_ITEMS = 1000
#: Items up to which a task holds all of them to draw from.
DRAWN = 100_000
#: Numbers in the matrices of users that are solved at a time.
CELLS = 1 << 20


def build_interactions(rows: DataFrame, *, min_user: int = 5, min_item: int = 10) -> DataFrame:
    """Rows of users with ``min_user`` rows and items with ``min_item``, both counted before filtering."""
    users = rows.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") >= min_user).select("user")
    items = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_item).select("item")
    return rows.join(users, "user", "left_semi").join(items, "item", "left_semi")


def temporal_split(rows: DataFrame, *, quantile: float = 0.8) -> DataFrame:
    """``rows`` (ts) with role: train up to one global quantile of time, test after it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = exact_quantiles(rows, at, [quantile]).select(F.get("cuts", F.lit(0)).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("role", F.when(at <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def _rank(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("user", "item", "rank")


def popularity(train: DataFrame, users: DataFrame, *, k: int = 10) -> DataFrame:
    """The most frequent items that the user has not seen (ties: lowest item).

    A user who has seen s items finds k unseen ones among the k + s most popular, so a user is joined
    with that many ranks and no more.
    """
    ranked = train.groupBy("item").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "item")
    seen = train.select("user", "item").distinct()
    need = seen.groupBy("user").agg(F.count("*").alias("seen")).join(users, "user", "right").select("user", (F.coalesce("seen", F.lit(0)) + k).alias("need"))
    most = need.agg(F.max("need").alias("m")).first()["m"] or 0
    top = ranked.limit(int(most)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item")))
    offered = need.select("user", F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("place")).join(top, "place").select("user", "item", "score")
    return _rank(offered.join(seen, ["user", "item"], "left_anti"), k)


def item_similarity(train: DataFrame, *, neighbours: int = 50) -> DataFrame:
    """(item, other, similarity): cosine of the binary columns, each item's strongest neighbours (ties kept)."""
    seen = train.select("user", "item").distinct()
    # A heavy user's items are dealt into blocks, and each pair of blocks is a row, so no task pairs all of them.
    size = F.count("*").over(Window.partitionBy("user"))
    dealt = seen.withColumn("blocks", F.ceil(size / ITEM_BLOCK)).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).groupBy("user", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    sets = met.agg(F.sort_array(F.collect_list(F.struct("item", "block"))).alias("items"))
    first = sets.select("lo", "hi", "items", F.posexplode("items").alias("k", "x"))
    pairs = first.select("lo", "hi", "x", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("y")).where("lo = hi or x.block <> y.block").select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = seen.groupBy("item").agg(F.count("*").alias("c"))
    joined = both.join(counts.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(counts.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b")
    one = joined.select("a", "b", (F.col("n") / F.sqrt(F.col("ca") * F.col("cb"))).alias("similarity"))
    full = one.select(F.col("a").alias("item"), F.col("b").alias("other"), "similarity").unionByName(one.select(F.col("b").alias("item"), F.col("a").alias("other"), "similarity"))
    return full.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("similarity")))).where(F.col("r") <= neighbours).drop("r")


def item_knn(train: DataFrame, users: DataFrame, *, neighbours: int = 50, k: int = 10) -> DataFrame:
    """Unseen items by the summed similarity of the user's items."""
    seen = train.select("user", "item").distinct()
    similar = item_similarity(train, neighbours=neighbours)
    scores = seen.join(users, "user", "left_semi").join(similar, "item").groupBy("user", F.col("other").alias("item")).agg(F.round(F.sum("similarity"), 9).alias("score"))
    return _rank(scores.join(seen, ["user", "item"], "left_anti"), k)


def random_items(train: DataFrame, users: DataFrame, *, k: int = 10, seed: int = 0) -> DataFrame:
    """The ``k`` unseen items of the highest draws: a seeded hash (MD5, the same in every engine) of user and item.

    All items are drawn for every user. Up to ``DRAWN`` items, a task has them all and keeps a user's best; more are joined.
    """
    spark = train.sparkSession
    ship(spark)
    kinds = dict(train.dtypes)
    wanted, seen = users.select("user").distinct(), train.select("user", "item").distinct()
    items = train.where("item is not null").select("item").distinct()
    held = items.orderBy("item").limit(DRAWN + 1).select("item", F.col("item").cast("string").alias("name")).collect()
    if len(held) > DRAWN:
        draw = F.substring(F.md5(F.concat_ws("/", F.col("user").cast("string"), F.col("item").cast("string"), F.lit(str(seed)))), 1, 8)
        return _rank(wanted.crossJoin(items).join(seen, ["user", "item"], "left_anti").withColumn("score", draw), k)
    if not held:
        return train.select("user", "item", F.lit(0).alias("rank")).limit(0)
    codes = F.broadcast(spark.createDataFrame([(r["item"], c) for c, r in enumerate(held)], f"item {kinds['item']}, code int"))  # DRAWN rows at most
    sets = seen.join(codes, "item").groupBy("user").agg(F.collect_list("code").alias("codes"))
    asked = wanted.join(sets, "user", "left").select("user", F.col("user").cast("string").alias("name"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    ends = spark.sparkContext.broadcast([f"{r['name']}/{seed}".encode() for r in held])

    def choose(batches):
        for batch in batches:
            rows, best = [], []
            for row, (name, codes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = b"" if name is None else f"{name}/".encode()
                drawn = np.frombuffer(b"".join([md5(own + end, usedforsecurity=False).digest()[:4] for end in ends.value]), ">u4").astype(np.int64)
                drawn[codes] = -1
                top = np.argsort(-drawn, kind="stable")[:k]
                top = top[drawn[top] >= 0]
                rows.append(np.full(len(top), row))
                best.append(top)
            if rows:
                places = [np.arange(len(b)) for b in best]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c).astype(np.int32)) for c in (best, places))], names=["user", "code", "rank"])

    return asked.mapInArrow(choose, f"user {kinds['user']}, code int, rank int").join(codes, "code").select("user", "item", "rank")


def _als_of_few(train: DataFrame, users: DataFrame, items: list, factors: int, regularisation: float, alpha: float, iterations: int, seed: int, k: int) -> DataFrame:
    """Alternating least squares over the users' sets of item codes, which follow the order of ``items``.

    Given the items' factors, a user's are the solution of their own normal equations, so they are never stored: a pass
    solves for each user and adds up the normal equations of all items, which the driver solves. A last pass scores.
    """
    spark = train.sparkSession
    ship(spark)
    kinds, n, f = dict(train.dtypes), len(items), factors
    if not n:
        return train.select("user", "item", F.lit(0).alias("rank")).limit(0)
    codes = F.broadcast(spark.createDataFrame([(item, c) for c, item in enumerate(items)], f"item {kinds['item']}, code int"))  # FEW_ITEMS rows at most
    sets = train.where("user is not null").select("user", "item").distinct().join(codes, "item").groupBy("user").agg(F.collect_list("code").alias("codes"))
    sets = checkpointed(sets.join(users.select("user", F.lit(True).alias("asked")).distinct(), "user", "left"))
    start = np.random.default_rng(seed).standard_normal((n, f))
    start /= np.linalg.norm(start, axis=1, keepdims=True)

    def solved(y: np.ndarray, column: pa.Array):
        """(first row, which user has which item, users' factors) of some users at a time."""
        gram, outer = y.T @ y, (y[:, :, None] * y[:, None, :]).reshape(n, f * f)
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, flat = np.cumsum(size), column.flatten().to_numpy(zero_copy_only=False)
        step = max(1, CELLS // max(n, f * f))
        for a in range(0, len(size), step):
            some = size[a : a + step]
            has = np.zeros((len(some), n))
            has[np.repeat(np.arange(len(some)), some), flat[ends[a] - size[a] : ends[a + len(some) - 1]]] = 1.0
            left = gram + alpha * (has @ outer).reshape(-1, f, f)
            left[:, np.arange(f), np.arange(f)] += regularisation * some[:, None]
            yield a, has, np.linalg.solve(left, (1 + alpha) * (has @ y)[:, :, None])[:, :, 0]

    def items_of(y: np.ndarray) -> np.ndarray:
        """The items' factors that follow from those before."""

        def add(batches):
            outer, pull, count, gram = np.zeros((n, f * f)), np.zeros((n, f)), np.zeros(n), np.zeros((f, f))
            for batch in batches:
                for _, has, x in solved(y, batch.column(0)):
                    outer += has.T @ (x[:, :, None] * x[:, None, :]).reshape(-1, f * f)
                    pull, count, gram = pull + has.T @ x, count + has.sum(axis=0), gram + x.T @ x
            each = np.concatenate([outer, pull, count[:, None]], axis=1)
            sums = [*each.tolist(), np.concatenate([gram.ravel(), np.zeros(f + 1)]).tolist()]
            yield pa.RecordBatch.from_pydict({"code": pa.array(range(n + 1), pa.int32()), "s": sums})

        found = sets.select("codes").mapInArrow(add, "code int, s array<double>").groupBy("code").agg(Summarizer.sum(array_to_vector("s")).alias("s")).orderBy("code").collect()  # items x factors x factors
        sums = np.array([r["s"].toArray() for r in found])
        left = sums[n, : f * f].reshape(f, f) + alpha * sums[:n, : f * f].reshape(n, f, f)
        left[:, np.arange(f), np.arange(f)] += regularisation * sums[:n, -1:]
        return np.linalg.solve(left, (1 + alpha) * sums[:n, f * f : f * f + f, None])[:, :, 0]

    y = start
    for _ in range(iterations):
        y = items_of(y)
    shown = min(k, n)

    def score(batches):
        for batch in batches:
            for a, has, x in solved(y, batch.column(1)):
                scores = np.where(has > 0, np.inf, -(x @ y.T))
                best = np.argsort(scores, axis=1, kind="stable")[:, :shown]
                q, rank = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + q)), pa.array(best[q, rank].astype(np.int32)), pa.array(rank.astype(np.int32))], names=["user", "code", "rank"])

    ranked = sets.where("asked").select("user", "codes").mapInArrow(score, f"user {kinds['user']}, code int, rank int")
    return ranked.join(codes, "code").select("user", "item", "rank")


def als(train: DataFrame, users: DataFrame, *, factors: int = 16, regularisation: float = 0.05, alpha: float = 20.0, iterations: int = 12, seed: int = 0, k: int = 10) -> DataFrame:
    """Implicit-feedback factorisation; the penalty is scaled by the number of ratings, as Spark does.

    Up to ``FEW_ITEMS`` items, a step of both sides is one pass over the users (``_als_of_few``); more are left to Spark's ALS.
    """
    items = train.where("item is not null").select("item").distinct().orderBy("item").limit(FEW_ITEMS + 1).collect()
    if len(items) <= FEW_ITEMS:
        return _als_of_few(train, users, [r["item"] for r in items], factors, regularisation, alpha, iterations, seed, k)
    pairs = train.select(F.col("user").cast("string").alias("u"), F.col("item").cast("string").alias("i")).distinct()
    iu, ii = StringIndexer(inputCol="u", outputCol="ui").fit(pairs), StringIndexer(inputCol="i", outputCol="ix").fit(pairs)
    data = ii.transform(iu.transform(pairs)).select(F.col("ui").cast("int").alias("ui"), F.col("ix").cast("int").alias("ix"), F.lit(1.0).alias("r"), "u", "i")
    model = ALS(rank=factors, maxIter=iterations, regParam=regularisation, alpha=alpha, implicitPrefs=True, userCol="ui", itemCol="ix", ratingCol="r", seed=seed).fit(data)
    # Users are offered k items more than they have seen, by classes of doubling size: one heavy user lengthens only its own list.
    asked = data.join(users.select(F.col("user").cast("string").alias("u")).distinct(), "u", "left_semi")
    need = asked.groupBy("ui").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("size")).cache()
    offered = None
    for (size,) in sorted(need.select("size").distinct().collect()):
        one = model.recommendForUserSubset(need.where(F.col("size") == size).select("ui"), k + (1 << size)).select("ui", F.explode("recommendations").alias("e")).select("ui", F.col("e.ix").alias("ix"), F.col("e.rating").alias("score"))
        offered = one if offered is None else offered.unionByName(one)
    need.unpersist()
    if offered is None:
        return train.select("user", "item", F.lit(0).alias("rank")).limit(0)
    names = data.select("ui", F.col("u")).distinct().join(offered, "ui").join(data.select("ix", "i").distinct(), "ix")
    kinds = dict(train.dtypes)
    scored = names.select(F.col("u").cast(kinds["user"]).alias("user"), F.col("i").cast(kinds["item"]).alias("item"), "score").join(users, "user", "left_semi")
    return _rank(scored.join(train.select("user", "item").distinct(), ["user", "item"], "left_anti"), k)


def evaluate(recommended: DataFrame, train: DataFrame, test: DataFrame, *, k: int = 10) -> DataFrame:
    """One row (precision, recall, ndcg, coverage, novelty, users) over users with test items and recommendations."""
    recommended = checkpointed(recommended)  # k rows a user, read twice
    relevant = test.select("user", "item").distinct().withColumn("hit", F.lit(1))
    sizes = relevant.groupBy("user").agg(F.count("*").alias("relevant"))
    total = train.agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items"))
    counts = train.groupBy("item").agg(F.count("*").alias("c"))
    rows = recommended.join(sizes, "user").join(relevant, ["user", "item"], "left").join(counts, "item", "left").crossJoin(F.broadcast(total))
    gain = 1 / F.log2(F.col("rank") + 2)
    per = rows.groupBy("user").agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.first("relevant").alias("relevant"), F.count("*").alias("shown"), F.sum(F.when(F.col("hit") == 1, gain).otherwise(0.0)).alias("gain"),
        F.avg(-F.log2(F.greatest(F.coalesce("c", F.lit(0)) / F.col("rows"), F.lit(1e-12)))).alias("novelty"),
    )
    ideal = F.aggregate(F.sequence(F.lit(0), F.least("relevant", "shown") - 1), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 2))
    means = per.agg(F.avg(F.col("hits") / k).alias("precision"), F.avg(F.col("hits") / F.col("relevant")).alias("recall"), F.avg(F.col("gain") / ideal).alias("ndcg"), F.avg("novelty").alias("novelty"), F.count("*").alias("users"))
    shown = rows.agg((F.countDistinct("item") / F.max("items")).alias("coverage"))
    return means.crossJoin(shown).select("precision", "recall", "ndcg", "coverage", "novelty", "users")
