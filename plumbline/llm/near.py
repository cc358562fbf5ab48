"""N-gram Jaccard join of documents: MinHash LSH forest with exact verification.

Texts with the same set of word shingles are one *class*; classes are joined, not copies. Each tree of the forest
is a sorted list of signature prefixes. Prefixes are shortened from ``deepest`` values until pairs at the
threshold meet in some tree with the target recall, 1 - (1 - t**depth)**trees; as that holds for every class
alike, values beyond are not drawn. At that depth each class is linked to its next one in the list, so a
common prefix makes a chain and no hub. Chains of all trees connect candidates; within such a group (in
blocks, if it is large) the pairs that share a prefix in some tree are verified exactly. A group of more
blocks than trees, which chains of unlike texts may make, is verified prefix by prefix instead, each pair at
the first prefix that it shares, so no class is copied more often than its prefixes have blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T
from plumbline.llm.graph import checkpointed, components, salted_join

WORDS = 5


def prefix_depth(threshold: float, trees: int, recall: float, deepest: int = 8) -> int:
    """The longest prefix, shortened from ``deepest``, at which pairs at the threshold meet with ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``n`` words, or all words if they are fewer."""
    out: list[np.ndarray] = []
    for _, part in T.chunks(texts):
        words, counts = T.words(part, ~T.SPACES, fold=False)
        grams, runs = T.ngrams(words, counts, n)
        at = at_word = 0
        for count, run in zip(counts.tolist(), runs.tolist(), strict=True):
            if run:
                out.append(np.unique(grams[at : at + run]))
            elif count:
                out.append(T.ngrams(words[at_word : at_word + count], np.array([count]), count)[0])
            else:
                out.append(np.empty(0, np.uint64))
            at, at_word = at + run, at_word + count
    return out


class Forest:
    """Prefixes of the signatures of shingle sets, one for each tree."""

    def __init__(self, trees: int, depth: int) -> None:
        rng = np.random.default_rng(411)
        self.trees, self.depth = trees, depth
        self.xor = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2)
        self.times = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefixes(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, trees): tree and values hashed together."""
        sizes = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
        keys = np.empty((len(sets), self.trees), np.uint64)
        for tree in range(self.trees):
            key = np.full(len(sets), tree + 1, np.uint64)
            for k in range(self.depth):
                at = tree * self.depth + k
                h = (flat ^ self.xor[at]) * self.times[at]
                least = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[:, tree] = key
        return keys


def _met(left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """Whether each left class shares a prefix with each right class in some tree (``tree`` -1), or in ``tree`` first."""
    if tree < 0:
        met = np.zeros((len(left), len(right)), bool)
        for k in range(left.shape[1]):
            met |= left[:, k, None] == right[None, :, k]
        return met
    met = left[:, tree, None] == right[None, :, tree]
    for k in range(tree):
        met &= left[:, k, None] != right[None, :, k]
    return met


def _linked(sets: list[np.ndarray], keys: np.ndarray, tree: int, rows: range, columns: range, threshold: float):
    """For each row member: the column members after it that it met (in ``tree`` first, unless that is -1) and whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    met = _met(keys[rows.start : rows.stop], keys[columns.start : columns.stop], tree)
    for i in rows:
        others = columns.start + np.flatnonzero(met[i - rows.start])
        # Sizes alone bound the similarity.
        others = others[(others > i) & (np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - 1e-9)]
        if not len(others):
            continue
        mark[ids[starts[i] : starts[i] + sizes[i]]] = True
        counts, own = sizes[others], np.cumsum(sizes[others]) - sizes[others]
        flat = ids[np.repeat(starts[others] - own, counts) + np.arange(counts.sum())]
        both = np.add.reduceat(mark[flat].astype(np.int64), own)
        mark[ids[starts[i] : starts[i] + sizes[i]]] = False
        yield i, others[both >= threshold * (counts + sizes[i] - both) - 1e-9]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = 0.8, recall: float = 0.99999, trees: int = 24, deepest: int = 8, block: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, class_id, copy_id, n_copies, n_links) of every row of ``docs``.

    ``n_links``: the number of other shingle sets with a similarity of ``threshold`` or more;
    ``n_copies``: rows with the same shingle set, itself included; ``copy_id``: their least id;
    ``class_id``: the least id of all documents that links and copies connect. Texts of fewer than
    ``words`` words have one shingle, all their words. Null and empty texts have none, and are classes
    of their own. Null ids are carried, but no class has one unless all its ids are null. Repeated
    rows count as copies. An empty table gives an empty result; other columns are ignored.

    Verification compares the pairs of classes that share a prefix; it runs in blocks of ``block`` classes (or
    ``block_bytes`` of shingles), dealt out by block pair. Copies of a class are as many as its group has blocks,
    or, where that is more than ``trees``, as its prefixes have. Texts that all share one prefix are compared
    pair by pair, which no exact way can spare.
    """
    spark = docs.sparkSession
    T.prepare(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    forest = Forest(trees, prefix_depth(threshold, trees, recall, deepest))

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), T.utf8(batch.column(1))
            for start, part in T.chunks(texts):
                sets = shingle_sets(part, words)
                filled = [i for i, x in enumerate(sets) if len(x)]
                keys: list[list[int] | None] = [None] * len(part)
                if filled:
                    for i, own in zip(filled, forest.prefixes([sets[i] for i in filled]).view(np.int64).tolist(), strict=True):
                        keys[i] = own
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(start, len(part)), "c": pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    "size": pa.array([len(x) for x in sets], pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())),
                })

    signed = checkpointed(source.mapInArrow(sign, f"id {kind}, c binary, size long, keys array<long>"))
    classes = signed.where("c is not null").groupBy("c").agg(F.count("*").alias("n_copies"), F.min("id").alias("copy_id"), F.max("size").alias("size"), F.min_by("keys", "size").alias("keys"))
    classes = checkpointed(classes)

    def neighbours(batches):
        """Links of each class to the next one of its tree's sorted list, as long as the prefix agrees."""
        key, last = None, None
        for batch in batches:
            rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pairs = []
            for k, c in zip(*rows, strict=True):
                if k == key and c != last:
                    pairs.append((last, c))
                key, last = k, c
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs, strict=True)], names=["u", "v"])

    lists = classes.select(F.explode("keys").alias("key"), "c")
    candidates = checkpointed(components(lists.repartition("key").sortWithinPartitions("key", "c").mapInArrow(neighbours, "u binary, v binary")))
    candidates = candidates.join(classes.select(F.col("c").alias("node"), "copy_id", "size", "keys"), "node")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") * 8 / block_bytes)).cast("int").alias("blocks")
    members = checkpointed(salted_join(candidates, candidates.groupBy("root").agg(parts), "root", "node").select("node", "copy_id", "root", "blocks", "size", "keys"))
    # Groups to verify in: the component itself or, where that is of many blocks, each prefix with two classes or more.
    few = members.where(F.col("blocks") <= trees).select("node", "copy_id", "keys", F.array(F.struct(F.lit(-1).alias("tree"), F.col("root").alias("group"), F.col("blocks"))).alias("groups"))
    many = members.where(F.col("blocks") > trees).select("node", "copy_id", "size", "keys", F.posexplode("keys").alias("tree", "key"))
    runs = many.groupBy("key").agg(F.count("*").alias("n"), parts).where("n > 1").drop("n")
    many = salted_join(many, runs, "key", "node").withColumn("group", F.encode(F.col("key").cast("string"), "UTF-8"))
    many = many.groupBy("node").agg(F.first("copy_id").alias("copy_id"), F.first("keys").alias("keys"), F.collect_list(F.struct("tree", "group", "blocks")).alias("groups"))  # one for each tree at most
    members = few.unionByName(many)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column(0), T.utf8(batch.column(1))
            for start, part in T.chunks(texts):
                sets = shingle_sets(part, words)
                yield pa.RecordBatch.from_pydict({"id": ids.slice(start, len(part)), "c": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "z": pa.array([press.compress(x) for x in part], pa.binary())})

    def deal(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, node, groups, keys in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, own = shingle_sets([unpress.decompress(z)], words)[0].tobytes(), np.array(keys, np.int64).tobytes()
                for g in groups:
                    n, mine = g["blocks"], xxhash.xxh3_64_intdigest(node) % g["blocks"]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([g["tree"]] * n, pa.int32()), "root": pa.array([g["group"]] * n, pa.binary()), "i": pa.array([min(mine, x) for x in range(n)], pa.int32()), "j": pa.array([max(mine, x) for x in range(n)], pa.int32()),
                        "right": pa.array([x < mine for x in range(n)]), "c": pa.array([node] * n, pa.binary()), "data": pa.array([data] * n, pa.binary()), "keys": pa.array([own] * n, pa.binary()),
                    })

    texts = source.mapInArrow(pack, f"id {kind}, c binary, z binary").alias("t")
    dealt = (
        texts.join(members.alias("m"), (F.col("t.c") == F.col("m.node")) & F.col("t.id").eqNullSafe(F.col("m.copy_id")))
        .select("t.z", "m.node", "m.groups", "m.keys").mapInArrow(deal, "tree int, root binary, i int, j int, right boolean, c binary, data binary, keys binary")
    )

    def verify(group):
        """Rows (class, links, least class linked with it here) of one block pair."""
        seen: dict[bytes, tuple[bool, bytes, bytes]] = {}
        for row in group:
            seen.setdefault(row[5], (row[4], row[6], row[7]))  # repeated rows of one document come once
        names = sorted(seen, key=lambda c: (seen[c][0], c))
        left = sum(not seen[c][0] for c in names)
        rows, columns = (range(len(names)), range(len(names))) if group[0][2] == group[0][3] else (range(left), range(left, len(names)))
        if not len(rows) or not len(columns) or len(names) < 2:
            return []
        links, parent = [0] * len(names), list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, hits in _linked([np.frombuffer(seen[c][1], np.uint64) for c in names], np.array([np.frombuffer(seen[c][2], np.int64) for c in names]), group[0][0], rows, columns, threshold):
            links[i] += len(hits)
            for j in hits.tolist():
                links[j] += 1
                parent[find(j)] = find(i)
        least: dict[int, bytes] = {}
        for k, c in enumerate(names):
            least[find(k)] = min(least.get(find(k), c), c)
        return [(c, links[k], least[find(k)]) for k, c in enumerate(names) if links[k]]

    def verified(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if held and row[:4] != held[0][:4]:
                    out += verify(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["c", "links", "least"])
                out = []
        if held and (out := verify(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["c", "links", "least"])

    found = checkpointed(dealt.repartition("tree", "root", "i", "j").sortWithinPartitions("tree", "root", "i", "j").mapInArrow(verified, "c binary, links long, least binary"))
    roots = components(found.select(F.col("c").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("c"), "root")
    links = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    grouped = classes.select("c", "n_copies", "copy_id").join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    heads = grouped.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = salted_join(grouped, heads, "root", "c").select("c", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("id", "c").join(known, "c", "left")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
