"""Vectorised text kernels shared by the operators: words, word hashes, n-gram hashes.

A *batch* is a list of UTF-8 byte strings. Kernels join the strings with a line feed, which no
word can hold, so that one pass of NumPy serves many texts; batches are cut to about
``CHUNK_BYTES`` so that the byte-level arrays stay small, whatever the size of a record batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.session import ship

#: Bytes of text that a kernel works on at a time (a longer text is worked on alone).
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that Spark hands to Python: whole texts, so not the default 10,000.
ARROW_ROWS = "1000"

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def prepare(spark) -> None:
    """Set what every operator of this package needs of a session: small Arrow batches, its code on workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 (null: empty)."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of runs of texts with ``most`` bytes at most, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            base = np.full(size, _BASE, np.uint64)
            back = np.full(size, _INVERSE, np.uint64)
            base[0] = back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()

#: Byte classes. Fixed values of the contracts: ASCII white space is 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII and all bytes from 0x80: what ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` admits after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256)
FOLD[0x41:0x5B] += 0x20


def word_parts(texts: list[bytes], inside: np.ndarray, fold: bool, prefixes: tuple[int, ...] = (), suffixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """([hash of each word, then of its first or last bytes], number of words of each text).

    A word is a longest run of bytes of ``inside``; ``fold`` reads A-Z as a-z. Hashes have 64 bits and
    depend on the bytes alone.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(inside[data].view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.get(len(data) + 1)
    table = _TABLE[FOLD] if fold else _TABLE
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=total[1:])
    spans = [(begin, end), *((begin, np.minimum(begin + n, end)) for n in prefixes), *((np.maximum(end - n, begin), end) for n in suffixes)]
    counts = np.diff(np.searchsorted(begin, np.cumsum(lengths + 1)), prepend=0)
    return [mix((total[b] - total[a]) * down[a]) for a, b in spans], counts


def words(texts: list[bytes], inside: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), as in ``word_parts``."""
    (hashes,), counts = word_parts(texts, inside, fold)
    return hashes, counts


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words within a text, number of runs of each text)."""
    runs = np.maximum(counts - n + 1, 0)
    if len(hashes) < n:
        return np.empty(0, np.uint64), runs
    size = len(hashes) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + hashes[k : k + size]
    starts = np.cumsum(counts) - counts
    keep = np.repeat(starts, runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    return mix(h[keep]), runs


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``counts`` values each (0 for empty segments)."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
