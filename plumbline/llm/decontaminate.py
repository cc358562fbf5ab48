"""Benchmark decontamination by winnowing.

Texts are sequences of words. A text's fingerprints are the least k-gram hashes of its sliding
windows of w k-grams; with k + w - 1 = span, texts that share ``span`` consecutive words share a
fingerprint. Benchmark items of fewer words than ``span`` are one window each, fingerprinted by the
hash of all their words; documents are then hashed at those lengths too. Fingerprints of documents
and items are joined, and each hit is extended word by word into the windows that occur.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T

SPAN = 13
K = 5
#: Parts of a frequent fingerprint's or item's documents where they are joined.
SALTS = 8


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def winnow(hashes: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, number of each text): the distinct least k-gram hashes of each text's windows."""
    grams, runs = T.ngrams(hashes, counts, k)
    found, sizes, at = [], np.zeros(len(counts), np.int64), 0
    if len(grams) >= window:
        least = _sliding_min(grams, window)
        keep = np.concatenate([[True], least[1:] != least[:-1]])
        starts = np.cumsum(runs) - runs
    for i, n in enumerate(runs):
        if n >= window:
            at = starts[i]
            own, first = least[at : at + n - window + 1], keep[at : at + n - window + 1].copy()
            first[0] = True
            found.append(own[first])
            sizes[i] = first.sum()
    return np.concatenate(found) if found else np.empty(0, np.uint64), sizes


def window_hashes(words: np.ndarray, span: int) -> np.ndarray:
    """Hashes of an item's windows: its runs of ``span`` words, or all of its words if they are fewer."""
    n = min(len(words), span)
    return T.ngrams(words, np.array([len(words)]), n)[0] if n else np.empty(0, np.uint64)


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, share: int = 20, broadcast_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    ``contaminated``: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words and
    are clean; null and empty items have no window; equal items (or repeated ids) count once by id;
    repeated documents each get a row; empty tables give empty results or clean documents; other
    columns are ignored. Item ids of a document are kept as a sorted list of strings. With ``carry`` all
    columns of ``docs`` come along in a struct ``row``, so that a selection needs no join.

    Plan: an item becomes a row of its fingerprints and window hashes. Document fingerprints meet the
    items' by broadcast when all items are measured to fit ``broadcast_bytes`` and by shuffle otherwise;
    then the windows of an item are joined once for each document that one of its fingerprints hit, and
    extended there.
    """
    spark = docs.sparkSession
    T.prepare(spark)
    if not 1 <= k <= span:
        raise ValueError("k must be in 1..span")
    width = span - k + 1

    def item_rows(batches):
        """An item's fingerprints, length of a window, and its distinct windows."""
        for batch in batches:
            out: dict[str, list] = {"item": [], "n": [], "prints": [], "windows": []}
            for item, text in zip(batch.column(0).to_pylist(), T.utf8(batch.column(1)), strict=True):
                words, counts = T.words([text], T.ALNUM, fold=True)
                if item is None or not len(words):
                    continue
                n = min(len(words), span)
                windows = np.unique(window_hashes(words, span))
                prints = np.unique(winnow(words, counts, k, width)[0]) if n == span else windows
                for key, value in (("item", str(item)), ("n", n), ("prints", prints.view(np.int64).tolist()), ("windows", windows.tobytes())):
                    out[key].append(value)
            yield pa.RecordBatch.from_pydict({"item": pa.array(out["item"], pa.string()), "n": pa.array(out["n"], pa.int32()), "prints": pa.array(out["prints"], pa.list_(pa.int64())), "windows": pa.array(out["windows"], pa.binary())})

    # A row for each item: its windows are held once, whatever the number of its fingerprints.
    rows_of_items = items.select(F.col(item_col), F.col(item_text_col)).mapInArrow(item_rows, "item string, n int, prints array<long>, windows binary")
    size = rows_of_items.agg(F.coalesce(F.sum(F.length("windows") + 8 * F.size("prints") + F.length("item") + 40), F.lit(0)).alias("bytes"), F.collect_set("n").alias("n")).first()
    short = sorted(n for n in size["n"] if n < span)
    small = size["bytes"] <= broadcast_bytes
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def scan(batches, table=None):
        """Words of each text, and the items of which a fingerprint occurs (or all fingerprints)."""
        for batch in batches:
            ids, texts = batch.column(0), T.utf8(batch.column(1))
            for start, part in T.chunks(texts):
                words, counts = T.words(part, T.ALNUM, fold=True)
                owners, found = [], []
                for n in (span, *short):
                    if n == span:
                        fps, sizes = winnow(words, counts, k, width)
                    else:
                        fps, sizes = T.ngrams(words, counts, n)
                    owner = np.repeat(np.arange(len(part)), sizes)
                    if table is not None:
                        known = table.get(n, np.empty(0, np.uint64))
                        hit = known[np.minimum(np.searchsorted(known, fps), len(known) - 1)] == fps if len(known) else np.zeros(len(fps), bool)
                        owner, fps = owner[hit], fps[hit]
                    owners.append(owner)
                    found.append(fps)
                row = batch.column(2).slice(start, len(part)) if batch.num_columns > 2 else None
                yield ids.slice(start, len(part)), row, part, words, counts, np.concatenate(owners), np.concatenate(found)

    def resolve(data: bytes, candidates) -> tuple[int, list[str]]:
        """Extend: (words inside an occurring window, ids of the items with such windows)."""
        words, counts = T.words([data], T.ALNUM, fold=True)
        covered, hit_items = np.zeros(len(words) + 1, np.int64), set()
        by_length: dict[int, list[tuple[str, np.ndarray]]] = {}
        for item, n, blob in candidates:
            by_length.setdefault(n, []).append((item, np.frombuffer(blob, np.uint64)))
        for n, entries in by_length.items():
            grams, _ = T.ngrams(words, counts, n)
            own = np.unique(grams)
            for item, windows in entries:
                if np.isin(windows, own).any():
                    hit_items.add(item)
            at = np.flatnonzero(np.isin(grams, np.concatenate([w for _, w in entries])))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
        return int((np.cumsum(covered)[:-1] > 0).sum()), sorted(hit_items)

    def result(ids, row, n_words, n_hit, found):
        return pa.RecordBatch.from_pydict(({"row": row} if carry else {}) | {
            "id": ids, "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in found], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]), "contaminated": pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()), "items": pa.array(found, pa.list_(pa.string())),
        })

    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    if carry:
        schema = f"row {source.schema['row'].dataType.simpleString()}, {schema}"
    if small:
        rows = rows_of_items.collect()  # at most broadcast_bytes, as measured above
        table = {n: np.unique(np.concatenate([np.array(r["prints"], np.int64) for r in rows if r["n"] == n]).view(np.uint64)) for n in {r["n"] for r in rows}}
        by_print: dict[int, set[tuple[str, int, bytes]]] = {}
        for r in rows:
            own = (r["item"], r["n"], bytes(r["windows"]))
            for fp in r["prints"]:
                by_print.setdefault(fp & (2**64 - 1), set()).add(own)

        def local(batches):
            for ids, row, part, _, counts, owner, fps in scan(batches, table):
                n_hit, found = [0] * len(part), [[] for _ in part]
                candidates: dict[int, set[tuple[str, int, bytes]]] = {}
                for i, fp in set(zip(owner.tolist(), fps.tolist(), strict=True)):
                    candidates.setdefault(i, set()).update(by_print[fp])
                for i, entries in candidates.items():
                    n_hit[i], found[i] = resolve(part[i], entries)
                yield result(ids, row, counts.tolist(), n_hit, found)

        return source.mapInArrow(local, schema).withColumnRenamed("id", id_col)

    def emit(batches):
        for ids, _, part, _, _, owner, fps in scan(batches):
            names = np.array([hashlib.blake2b(x, digest_size=8).digest() for x in part])
            yield pa.RecordBatch.from_pydict({"id": ids.take(pa.array(owner)), "digest": pa.array([bytes(names[i]) for i in owner], pa.binary()), "fp": pa.array(fps.view(np.int64))})

    def finish(batches):
        for batch in batches:
            n_words, n_hit, found = [], [], []
            for text, own in zip(T.utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                n_words.append(int(T.words([text], T.ALNUM, fold=True)[1][0]))
                hit, items_found = resolve(text, [(x["item"], x["n"], x["windows"]) for x in own or []])
                n_hit.append(hit)
                found.append(items_found)
            yield result(batch.column(0), batch.column(3) if carry else None, n_words, n_hit, found)

    names = source.columns

    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(dict(zip(names, batch.columns, strict=True)) | {"digest": pa.array([hashlib.blake2b(x, digest_size=8).digest() for x in T.utf8(batch.column(1))], pa.binary())})

    # Fingerprints find (document, item); the windows of an item come after, once for each such pair. A passage
    # that many documents or items share is a frequent fingerprint: documents' rows are salted.
    prints = rows_of_items.select(F.explode("prints").alias("fp"), "item", "n").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = source.select("id", "text").mapInArrow(emit, f"id {kind}, digest binary, fp long").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    pairs = found.join(prints, ["fp", "salt"]).select("id", "digest", "item", "n").distinct().withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    whole = rows_of_items.select("item", "n", "windows").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = pairs.join(whole, ["item", "n", "salt"]).groupBy("id", "digest").agg(F.collect_list(F.struct("item", "n", "windows")).alias("windows"))
    marked = source.mapInArrow(digest, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema) + ", digest binary").alias("d")
    joined = marked.join(hits.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.digest") == F.col("h.digest")), "left").select("d.id", "d.text", "h.windows", *(["d.row"] if carry else []))
    return joined.mapInArrow(finish, schema).withColumnRenamed("id", id_col)
