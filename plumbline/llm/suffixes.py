"""Suffix order by difference cover, in NumPy, as far as a given prefix length."""

from __future__ import annotations

import numpy as np


def _packed(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One integer for each row, in the lexicographic order of the columns (values below their size)."""
    key, span = columns[0].astype(np.int64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if span * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max(initial=0)) + 1
        key, span = key * size + column, span * size
    return key


def suffix_order(symbols: np.ndarray, need: int) -> np.ndarray:
    """Positions of ``symbols`` in the order of the first ``need`` symbols of their suffixes.

    The difference cover modulo 3: triples at positions 1 and 2 modulo 3 are sorted and named, the
    sequence of names is sorted by recursion (to a third of ``need``), the other suffixes follow
    from one symbol and the rank of the next position, and the two lists are merged. Suffixes that
    agree in ``need`` symbols come in any order.
    """
    n = len(symbols)
    size = int(symbols.max(initial=0)) + 2
    text = np.zeros(n + 4, np.int64)
    text[:n] = symbols
    text[:n] += 1
    if need <= 3 or n < 3:
        return np.argsort(_packed([text[:n], text[1 : n + 1], text[2 : n + 2]], [size] * 3), kind="stable")
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = np.unique(_packed([text[sample], text[sample + 1], text[sample + 2]], [size] * 3), return_inverse=True)[1]
    if names.max() + 1 == len(names):
        order = np.empty(len(names), np.int64)
        order[names] = np.arange(len(names))
    else:
        order = suffix_order(names, -(-need // 3))
    sampled = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    ranks = len(sampled) + 1
    rest = np.arange(0, n, 3)
    by_one = _packed([text[rest], rank[rest + 1]], [size, ranks])
    place = np.argsort(by_one, kind="stable")
    rest, by_one = rest[place], by_one[place]
    sampled = sampled[sampled < n]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before_one = np.searchsorted(np.sort(_packed([text[one], rank[one + 1]], [size, ranks])), by_one)
    both = np.concatenate([two, rest])
    keys = _packed([text[both], text[both + 1], rank[both + 2]], [size, size, ranks])
    before_two = np.searchsorted(np.sort(keys[: len(two)]), keys[len(two) :])
    # Ranks of suffixes that agree to the needed depth are arbitrary; among those the counts may step back.
    at = np.arange(len(rest)) + np.maximum.accumulate(before_one) + np.maximum.accumulate(before_two)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = sampled
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of ``order`` but the last: whether it and the next share ``length`` bytes.

    Every position of ``order`` must have ``length`` bytes of ``data``.
    """
    left, right = order[:-1], order[1:]
    same = np.ones(len(left), bool)
    if length < 8:
        for k in range(length):
            same &= data[left + k] == data[right + k]
        return same
    blocks = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    live = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        ok = blocks[left[live] + k] == blocks[right[live] + k]
        same[live[~ok]] = False
        live = live[ok]
    return same


def repeated_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Positions of the segments' windows of ``length`` bytes that occur at another position, too.

    Segments lie in ``data`` at ``starts`` with ``sizes`` bytes; windows do not cross their ends.
    """
    room = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, starts, room > 0)
    np.add.at(valid, starts + room, -(room > 0).astype(np.int64))
    order = suffix_order(data, length)
    order = order[np.cumsum(valid)[:-1][order] > 0]
    if len(order) < 2:
        return np.empty(0, np.int64)
    same = equal_neighbours(data, order, length)
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    return np.sort(order[hit])
