"""Suffix-array removal of byte strings that occur more than once in a corpus.

A byte is removed if it lies in a string of ``length`` bytes that starts at another place, too. Every
window of ``length`` bytes has a key: the least hash of its k-byte grams. Equal windows have equal
keys, so the windows of one key can be sorted apart from all others; a maximal run of windows with one
key is a *segment* of a text. Segments are counted by key and content:

* a segment that occurs more than once is repeated as a whole;
* a segment that shares its key with none holds no repeated window (unless its own text repeats);
* the others (about a tenth of the text) go, dealt out by key, to a suffix sort by difference cover
  (``suffixes.py``: sampled triples, recursion on names, merge), where equal windows are neighbours.

Keys whose segments exceed ``group_bytes`` are not sorted in one task: each of their windows becomes a
row of a 128-bit digest, counted with map-side combination.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T
from plumbline.llm.graph import checkpointed, salted_join
from plumbline.llm.suffixes import repeated_windows

GROUP_BYTES = 1_500_000
_GRAM = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of a text as two longs."""
    d = xxhash.xxh3_128_intdigest(data)
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


def segments(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, end of windows, whether the key's gram recurs) of each segment of a text."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, bool)
    parts, step = [], T.CHUNK_BYTES
    for at in range(0, n, step):
        key, first, end, again = _segments(data[at : at + step + length - 1], length)
        parts.append((key, first + at, end + at, again))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(data: bytes, length: int):
    gram = 1 << max(0, min(5, (length // 4).bit_length() - 1))
    grams = length - gram + 1
    with np.errstate(over="ignore"):
        h, base, span = _GRAM[np.frombuffer(data, np.uint8)], np.uint64(0x9E3779B97F4A7C15), 1
        while span < gram:
            h = h[:-span] * base + h[span:]
            base, span = base * base, span * 2
        h = T.mix(h)
    least, span = h, 1
    while span * 2 <= grams:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if grams > span:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(first[1:], len(least))
    windows = np.lib.stride_tricks.sliding_window_view(h, grams)
    again = np.empty(len(first), bool)
    for at in range(0, len(first), 4096):
        own = slice(at, at + 4096)
        early = first[own] + windows[first[own]].argmin(axis=1)
        late = end[own] - 1 + grams - 1 - windows[end[own] - 1][:, ::-1].argmin(axis=1)
        again[own] = early != late
    return least[first].view(np.int64), first, end, again


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spread(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ranges that windows at the sorted positions ``at`` cover."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, len(at) - 1)] + length).tolist(), strict=True))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(d1, d2, ranges): for each text with repeated strings, by its digest, the covered byte ranges."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def emit(batches):
        for batch in batches:
            texts = T.utf8(batch.column(1))
            own: list[list] = [[] for _ in range(8)]
            for i, data in enumerate(texts):
                key, first, end, again = segments(data, length)
                if not len(key):
                    continue
                d1, d2 = digest(data)
                view, n = memoryview(data), len(key)
                own[0].append(np.full(n, i))
                own[1].append(np.full(n, d1))
                own[2].append(np.full(n, d2))
                own[3].append(key)
                own[4].append(np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length - 1]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, n).view(np.int64))
                own[5].append(first)
                own[6].append(end)
                own[7].append(again)
            if own[0]:
                c = [np.concatenate(x) for x in own]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(c[0])), "d1": c[1], "d2": c[2], "key": c[3], "content": c[4], "a": c[5].astype(np.int32), "b": c[6].astype(np.int32), "again": pa.array(c[7])})

    rows = source.mapInArrow(emit, f"id {kind}, d1 long, d2 long, key long, content long, a int, b int, again boolean")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    # Most segments have a key of their own; all that follows works on the others.
    some = checkpointed(rows.join(shared, "key"))
    counts = some.groupBy("key", "content").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.max(F.col("b") - F.col("a")).alias("windows"))
    keys = counts.groupBy("key").agg(F.count("*").alias("segments"), F.max("again").alias("recurs"), F.sum(F.col("windows") + (length - 1)).alias("bytes")).where("segments > 1 or recurs")
    status = checkpointed(counts.join(keys.select("key", "bytes"), "key", "left").where("n > 1 or bytes is not null").select("key", "content", "n", "bytes"))
    marked = some.join(status, ["key", "content"])
    whole = marked.where("n > 1").select("d1", "d2", "a", (F.col("b") + (length - 1)).alias("b")).distinct()

    def wanted(chosen):
        """Segments to cut from their texts, at one place each, by text."""
        return (
            marked.where(chosen).groupBy("key", "content", "n").agg(F.min(F.struct("id", "d1", "d2", "a", "b")).alias("at"))
            .groupBy("at.id", "at.d1", "at.d2").agg(F.collect_list(F.struct("at.a", "at.b", "key", "n")).alias("segments"))
        )

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = T.utf8(batch.column(1))
            marks = [digest(x) for x in texts]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "d1": pa.array([m[0] for m in marks], pa.int64()), "d2": pa.array([m[1] for m in marks], pa.int64()), "z": pa.array([press.compress(x) for x in texts], pa.binary())})

    packed = source.mapInArrow(pack, f"id {kind}, d1 long, d2 long, z binary")

    def cut(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            own: dict[str, list] = {k: [] for k in ("key", "n", "d1", "d2", "at", "data")}
            size = 0
            for d1, d2, z, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = unpress.decompress(z)
                for s in found:
                    for k, v in (("key", s["key"]), ("n", s["n"]), ("d1", d1), ("d2", d2), ("at", s["a"]), ("data", data[s["a"] : s["b"] + length - 1])):
                        own[k].append(v)
                    size += s["b"] - s["a"] + length
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(own, cut_schema)
                        own, size = {k: [] for k in own}, 0
            if own["key"]:
                yield pa.RecordBatch.from_pydict(own, cut_schema)

    cut_schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])
    on = F.col("p.id").eqNullSafe(F.col("w.id")) & (F.col("p.d1") == F.col("w.d1")) & (F.col("p.d2") == F.col("w.d2"))

    def pieces(chosen):
        joined = packed.alias("p").join(wanted(chosen).alias("w"), on)
        return joined.select("p.d1", "p.d2", "p.z", "w.segments").mapInArrow(cut, "key long, n long, d1 long, d2 long, at int, data binary")

    def flush(held):
        data = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
        sizes = np.array([len(h[5]) for h in held])
        starts = np.cumsum(sizes) - sizes
        at = repeated_windows(data, starts, sizes, length)
        owner = np.searchsorted(starts, at, "right") - 1
        out: list[tuple] = []
        for i in np.unique(owner).tolist():
            _, n, d1, d2, begin, _ = held[i]
            if n == 1:  # the others are repeated as a whole
                out += [(d1, d2, a + begin, b + begin) for a, b in _spread(at[owner == i] - starts[i], length)]
        return out

    def order(batches):
        """Rows come sorted by key: suffix-sort whole keys, about ``group_bytes`` at a time."""
        held, size, key, seen = [], 0, None, set()
        for batch in batches:
            found = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if row[0] != key:
                    key, seen = row[0], set()
                    if size > group_bytes // 2:
                        found += flush(held)
                        held, size = [], 0
                if row[5] not in seen:  # the same segment again: repeated rows of one document
                    seen.add(row[5])
                    held.append(row)
                    size += len(row[5])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d1", "d2", "a", "b"])
        if held and (found := flush(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d1", "d2", "a", "b"])

    cold = (
        pieces(F.col("bytes") <= group_bytes)
        .repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(order, "d1 long, d2 long, a int, b int")
    )

    def windows(batches):
        for batch in batches:
            for n, d1, d2, at, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                view = memoryview(data)
                for lo in range(0, len(data) - length + 1, 1 << 16):
                    marks = [digest(view[k : k + length]) for k in range(lo, min(lo + (1 << 16), len(data) - length + 1))]
                    yield pa.RecordBatch.from_pydict({"w1": pa.array([m[0] for m in marks], pa.int64()), "w2": pa.array([m[1] for m in marks], pa.int64()), "n": pa.array([n] * len(marks), pa.int64()), "d1": pa.array([d1] * len(marks), pa.int64()), "d2": pa.array([d2] * len(marks), pa.int64()), "a": pa.array(range(at + lo, at + lo + len(marks)), pa.int32())})

    hot_rows = pieces(F.col("bytes") > group_bytes).dropDuplicates(["d1", "d2", "at"]).select("n", "d1", "d2", "at", "data").mapInArrow(windows, "w1 long, w2 long, n long, d1 long, d2 long, a int")
    recurring = hot_rows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    hot = salted_join(hot_rows.where("n = 1"), recurring, ["w1", "w2"], ["d1", "a"]).select("d1", "d2", "a", (F.col("a") + length).alias("b"))
    found = whole.unionByName(cold)
    if keys.where(F.col("bytes") > group_bytes).limit(1).count():
        found = found.unionByName(hot)
    return found.groupBy("d1", "d2").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_bytes: int = GROUP_BYTES, carry: bool = False) -> DataFrame:
    """(id, text, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    ``text`` is what is left, read as UTF-8 without characters that a cut has split (it may be empty);
    the figures are of bytes. Null and empty texts, and texts under ``length`` bytes, lose nothing.
    Repeated rows are documents of their own, so their texts repeat and are removed as a whole. Null
    ids are ids like others, an empty table gives an empty result, and other columns are ignored, or with
    ``carry`` come along in a struct ``row`` of all columns of ``docs`` but the text.
    """
    T.prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] if carry else []))
    also = f", row {source.schema['row'].dataType.simpleString()}" if carry else ""
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, length=length, group_bytes=group_bytes)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for n, batch in enumerate(batches):
            texts = T.utf8(batch.column(1))
            # A text too short for a window has a key of its own: it matches nothing, and such texts spread over all tasks.
            marks = [digest(x if len(x) >= length else f"{n}/{k}".encode()) for k, x in enumerate(texts)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "d1": pa.array([m[0] for m in marks], pa.int64()), "d2": pa.array([m[1] for m in marks], pa.int64()), "z": pa.array([press.compress(x) for x in texts], pa.binary())} | ({"row": batch.column(2)} if carry else {}))

    def finish(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpress.decompress(z)
                spans = _union([(r["a"], r["b"]) for r in found or []])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                for k, v in (("text", left.decode("utf-8", "ignore")), ("n_bytes", len(data)), ("n_removed", len(data) - len(left)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(out["text"], pa.string()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())} | ({"row": batch.column(3)} if carry else {}))

    packed = source.mapInArrow(pack, f"id {kind}, d1 long, d2 long, z binary{also}")
    # Exact copies share a key, so their rows are salted.
    joined = salted_join(packed, ranges, ["d1", "d2"], "id", "left", salts=8).select("id", "z", "ranges", *(["row"] if carry else []))
    return joined.mapInArrow(finish, f"id {kind}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string{also}").withColumnRenamed("id", id_col)
