"""Scoring texts with a weighted backoff automaton over word n-grams.

States are contexts: runs of up to ``order`` - 1 words, the first of which may be the start of a text, and
the empty context, called root. A state has an arc for each n-gram seen after it and a failure arc to the
state without its first word, so failure arcs chain down to root; root has an arc for each word and one
for unknown words. Arcs weigh log10 probabilities: with the share f(c) of a context seen c times,

    P(w)   = (c(w) + 1) / (N + V + 1)
    P(w|h) = (1 - f(c(h))) c(hw) / c(h) + f(c(h)) P(w|h'),    f(c) = max(floor, (1 + c) ** -power),

where h' is h without its first word; the failure arc of h weighs log10 f(c(h)), and every state's
probabilities sum to one. A text is traversed once from left to right: the state (the longest context that
was seen) and the accumulated log probability are carried along.

No machine holds the corpus's automaton. Texts are cut into *slices* of some MB, written once to the
shared folder. A slice asks for the counts of its distinct n-grams and adds its training counts to them
(sorted hashes, dealt out by range over *parts*); a part sums over all slices and answers each in the order
it asked; the slice builds the automaton of its own n-grams and traverses its texts. Repeated n-grams of a
slice travel once, so frequent words are no hot keys. A slice sends a message to a part only where it has
an n-gram for it, so there are never more messages than n-grams, at any number of parts.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import text as T
from plumbline.llm.graph import checkpointed
from plumbline.llm.warc import open_folder, shared_folder

SLICE_BYTES = 10 << 20
ORDER = 3
#: Bits of an n-gram's hash; the lowest ``_TAG`` tell the orders apart.
BITS, _TAG = 56, np.uint64(3)
_END, _START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B27D4EB2F)


def held_out(doc_id, modulus: int = 7, remainder: int = 2) -> bool:
    """Whether crc32 of the id as text leaves the remainder; a null id reads as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, tokens of each text): words of A-Z as a-z, then the end of the text."""
    hashes, sizes = [], []
    for _, part in T.chunks(texts):
        words, counts = T.words(part, ~T.SPACES, fold=True)
        hashes.append(np.insert(words, np.cumsum(counts), _END))
        sizes.append(counts + 1)
    return np.concatenate(hashes), np.concatenate(sizes)


class Slice:
    """N-grams of some texts: for each order the sorted distinct hashes, and each token's place in them (-1: none)."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        words, self.sizes = tokens(texts)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(words)) - np.repeat(self.first, self.sizes)
        self.kinds, self.place = [], []
        own = words
        for n in range(1, order + 1):
            if n > 1:
                before = np.empty_like(own)
                before[1:] = own[:-1]
                if n == 2:
                    before[self.first] = _START
                own = T.mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
            marked = ((own >> np.uint64(64 - BITS)) & ~((np.uint64(1) << _TAG) - np.uint64(1))) | np.uint64(n - 1)
            there = self.at >= n - 2  # a context reaches back to the start of the text at most
            place = np.full(len(words), -1, np.int64)
            kinds, place[there] = np.unique(marked[there], return_inverse=True)
            self.kinds.append(kinds)
            self.place.append(place)
        end = ((_END >> np.uint64(64 - BITS)) & ~((np.uint64(1) << _TAG) - np.uint64(1)))
        self.end = int(np.searchsorted(self.kinds[0], end))  # as many starts as ends

    def asked(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of all n-grams, their counts in the training texts)."""
        used = np.repeat(training, self.sizes)
        counts = np.concatenate([np.bincount(place[used & (place >= 0)], minlength=len(kinds)) for place, kinds in zip(self.place, self.kinds, strict=True)])
        hashes = np.concatenate(self.kinds)
        order = np.argsort(hashes)
        return hashes[order], counts[order]

    def answered(self, answers: np.ndarray) -> list[np.ndarray]:
        """Counts of the n-grams of each order, from answers in the order of ``asked``."""
        counts = np.empty(len(answers), np.int64)
        counts[np.argsort(np.concatenate(self.kinds))] = answers
        return np.split(counts, np.cumsum([len(k) for k in self.kinds])[:-1])


class Automaton:
    """The arcs of a slice's states, and the traversal of its texts."""

    def __init__(self, own: Slice, counts: list[np.ndarray], total: int, kinds: int, floor: float, power: float) -> None:
        self.own, self.counts, self.total, self.kinds, self.floor, self.power = own, counts, total, kinds, floor, power

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score by the automaton, score by root alone, known tokens) of each text.

        ``state`` is how many words of context a token is read in. Its arc weighs what the contexts up to
        there give; where an order has no arc, the failure arc's share of the next lower one is left.
        """
        own, first = self.own, self.own.first
        seen = [np.where(place >= 0, c[place], 0) for c, place in zip(self.counts, own.place, strict=True)]
        weight = root = (seen[0] + 1) / (self.total + self.kinds + 1)
        state = np.zeros(len(root), np.int64)
        for n in range(1, len(seen)):
            context = np.empty_like(seen[n - 1])
            context[1:] = seen[n - 1][:-1]
            context[first] = self.counts[0][own.end] if n == 1 else 0
            context[own.at < n - 1] = 0
            reached = (state == n - 1) & (context > 0)
            state[reached] = n
            share = np.maximum(self.floor, (1.0 + context) ** -self.power)
            weight = np.where(reached, (1 - share) * seen[n] / np.maximum(context, 1) + share * weight, weight)
        return np.add.reduceat(np.log10(weight), first), np.add.reduceat(np.log10(root), first), np.add.reduceat((seen[0] > 0).astype(np.int64), first)


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the ranges of sorted hashes that belong to each part."""
    bounds = [((p + 1) << BITS) // parts - 1 for p in range(parts)]
    return np.searchsorted(hashes, np.array(bounds, np.uint64), "right")


def _pack(hashes: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Sorted hashes as steps, byte by byte of significance: high bytes of steps are small."""
    steps = np.diff(hashes, prepend=np.zeros(1, np.uint64))
    return press.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes, unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpress.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _slices(batches, slice_bytes: int):
    """(ids, texts) of about ``slice_bytes``, across record batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), T.utf8(batch.column(1)), strict=True):
            if texts and size + len(t) > slice_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 50
    if texts:
        yield ids, texts


def _groups(batches, columns: int):
    """Rows of sorted batches by their first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def lm_score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, modulus: int = 7, remainder: int = 2, floor: float = 0.4, power: float = 0.25, slice_bytes: int = SLICE_BYTES,
    parts: int | None = None,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows that are not ``held_out``; n-grams have up to ``order`` words (1 to 8).
    Null and empty texts are one token, the end. Repeated rows each count and each get a row; an empty table
    gives an empty result; without any training row all words are unknown. Other columns are ignored. Scores
    are log10 probabilities. A text is one slice at least, so it must fit in a task, whatever its length.
    Slices stay in the shared checkpoint folder, as checkpoints do.
    """
    spark = docs.sparkSession
    T.prepare(spark)
    id_type = docs.select(id_col).schema[0].dataType
    kind, arrow_id = id_type.simpleString(), to_arrow_type(id_type)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folder = shared_folder(spark, "lm")

    def write(batches):
        files, where = open_folder(folder)
        files.create_dir(where, recursive=True)
        context, options = TaskContext.get(), pa.ipc.IpcWriteOptions(compression="zstd")
        for seq, (ids, texts) in enumerate(_slices(batches, slice_bytes)):
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.table({"id": pa.array(ids, arrow_id), "text": pa.array(texts, pa.large_binary())})
            with files.open_output_stream(f"{where}/{name}", compression=None) as out, pa.ipc.new_stream(out, table.schema, options=options) as sink:
                sink.write_table(table)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([(context.partitionId() << 32) + seq], pa.int64()), "name": [name]})

    def load(name: str) -> tuple[list, list[bytes], np.ndarray]:
        """(ids, texts, whether the model learns from each) of a slice."""
        files, where = open_folder(folder)
        with files.open_input_stream(f"{where}/{name}", compression=None) as stream:
            table = pa.ipc.open_stream(stream).read_all()
        ids = table.column(0).to_pylist()
        return ids, table.column(1).to_pylist(), np.array([not held_out(i, modulus, remainder) for i in ids], bool)

    # A row for each slice; from here on a lost task reads the same slices again.
    manifest = checkpointed(source.mapInArrow(write, "slice long, name string"))
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    manifest = manifest.repartition(parts, "slice")

    def vocabulary(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name in batch.column(1).to_pylist():
                _, texts, training = load(name)
                texts = [t for t, own in zip(texts, training.tolist(), strict=True) if own]
                if not texts:
                    continue
                words, _ = tokens(texts)
                kinds = np.unique(words >> np.uint64(64 - BITS))
                ends, at = _ranges(kinds, parts), 0
                for p, end in enumerate(ends.tolist()):
                    if end > at or not p:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([0 if p else len(words)], pa.int64()), "hashes": pa.array([_pack(kinds[at:end], press)], pa.binary())})
                    at = end

    def distinct(batches):
        unpress = zstandard.ZstdDecompressor()
        for rows in _groups(batches, 3):
            kinds = np.unique(np.concatenate([_unpack(r[2], unpress) for r in rows]))
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(r[1] for r in rows)], pa.int64()), "kinds": pa.array([len(kinds)], pa.int64())})

    figures = (
        manifest.mapInArrow(vocabulary, "part int, n long, hashes binary").repartitionById(parts, "part").sortWithinPartitions("part")
        .mapInArrow(distinct, "n long, kinds long").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).first()
    )
    total, kinds_total = figures["n"] or 0, figures["kinds"] or 0

    def ask(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, texts, training = load(name)
                hashes, counts = Slice(texts, order).asked(training)
                counts = counts.astype(np.uint32)
                ends, at = _ranges(hashes, parts), 0
                for p, end in enumerate(ends.tolist()):
                    if end > at:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "slice": pa.array([key], pa.int64()), "name": [name], "hashes": pa.array([_pack(hashes[at:end], press)], pa.binary()), "counts": pa.array([press.compress(counts[at:end].tobytes())], pa.binary())})
                    at = end

    def answer(batches):
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for rows in _groups(batches, 5):
            hashes = [_unpack(r[3], unpress) for r in rows]
            counts = np.concatenate([np.frombuffer(unpress.decompress(r[4]), np.uint32) for r in rows])
            known, place = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64)
            at = 0
            for r, h in zip(rows, hashes, strict=True):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([r[1]], pa.int64()), "part": pa.array([r[0]], pa.int32()), "name": [r[2]], "counts": pa.array([press.compress(sums[place[at : at + len(h)]].tobytes())], pa.binary())})
                at += len(h)

    def score(batches):
        unpress = zstandard.ZstdDecompressor()
        for rows in _groups(batches, 4):  # of one slice, in the order of the parts
            ids, texts, training = load(rows[0][2])
            own = Slice(texts, order)
            counts = own.answered(np.concatenate([np.frombuffer(unpress.decompress(r[3]), np.int64) for r in rows]))
            scores, base, known = Automaton(own, counts, total, kinds_total, floor, power).traverse()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), pa.array(~training), pa.array(own.sizes.astype(np.int64)), pa.array(known), pa.array([total] * len(ids), pa.int64()), pa.array(base), pa.array(scores)],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    questions = manifest.mapInArrow(ask, "part int, slice long, name string, hashes binary, counts binary").repartitionById(parts, "part").sortWithinPartitions("part")
    answers = questions.mapInArrow(answer, "slice long, part int, name string, counts binary").repartition(parts, "slice").sortWithinPartitions("slice", "part")
    return answers.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
