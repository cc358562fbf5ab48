"""Quality rules as a short-circuit cascade.

A rule is a predicate over lazily measured features of a text. On a bounded random sample the cascade
measures what each rule costs and how often it rejects, orders the rules by rejections per second,
and then evaluates them in that order, stopping at a text's first rejection. The order changes the
work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T

#: Symbols that the contract counts. Fixed value.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Marks that open a list item, and ends of cut-off lines. Fixed values.
BULLETS = ("•", "‣", "▶", "◀", "◦", "■", "□", "▪", "▫", "–", "-", "*")
CUT_OFF = ("...", "…")
#: A whole word without a letter (all bytes from 0x80 count as letters); each run is tried once, from its beginning.
_LETTERLESS = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z\x80-\xFF]++(?![^\x20\x09-\x0D])")


class Features:
    """Features of one text, each measured at most once and only when asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.data.split()  # of bytes: at 0x20 and 0x09-0x0D alone

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        continued = len(self.data) - len(self.data.translate(None, bytes(range(0x80, 0xC0))))
        return sum(map(len, self.words)) - continued

    def _n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    def _n_lines(self) -> int:
        return len(self.lines)

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _codes(self) -> np.ndarray:
        """A number for each word, equal for equal words, in the order in which they first come."""
        numbers: dict[bytes, int] = {}
        return np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, self.n_words)

    def _n_repeat_words(self) -> int:
        if self.n_words <= WINDOW:
            return 0
        # Windows of equal hash are compared word by word, so that chance matches don't count.
        words = self.codes
        size = self.n_words - WINDOW + 1
        mixed = np.zeros(size, np.uint64)
        for k in range(WINDOW):
            mixed = T.mix(mixed + words[k : k + size].astype(np.uint64))
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        if not same.any():
            return 0
        for k in range(WINDOW):
            same &= words[order[1:] + k] == words[order[:-1] + k]
        hit = np.zeros(size, bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        repeated = np.flatnonzero(hit)
        return int(np.minimum(np.diff(repeated, append=repeated[-1] + WINDOW), WINDOW).sum()) if len(repeated) else 0

    def _text(self) -> str:
        return self.data.decode("utf-8", "replace")

    def _text_lines(self) -> list[str]:
        return [y for x in self.text.split("\n") if (y := x.strip(" \t\n\v\f\r"))]

    def _n_bullets(self) -> int:
        return sum(x.startswith(BULLETS) for x in self.text_lines)

    def _n_cut_off(self) -> int:
        return sum(x.endswith(CUT_OFF) for x in self.text_lines)

    def _n_lettered(self) -> int:
        return self.n_words - len(_LETTERLESS.findall(self.data))

    def _top_pair_chars(self) -> int:
        """Characters (with the space) in occurrences of the most frequent pair of words; ties: the most characters."""
        if self.n_words < 2:
            return 0
        codes = self.codes
        kinds = int(codes.max()) + 1
        _, first, counts = np.unique(codes[:-1] * kinds + codes[1:], return_index=True, return_counts=True)
        most = int(counts.max())
        chars = lambda w: len(w.decode("utf-8", "replace"))
        return max(most * (chars(self.words[k]) + chars(self.words[k + 1]) + 1) for k in first[counts == most].tolist())

    def _n_chars(self) -> int:
        return len(self.text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


def default_rules(
    min_words: int = 10, repeat_percent: int = 20, dup_line_percent: int = 30, chars_per_word: tuple[int, int] = (2, 20), bullet_percent: int = 90, cut_off_percent: int = 30, lettered_percent: int = 45,
    pair_percent: int = 20, long_words: int = 50,
) -> list[Rule]:
    """The contract's two base rules; symbol density, duplicate lines, word length; then shares of list items,
    of cut-off lines, of words with a letter and of the most frequent pair of words (of texts over ``long_words``)."""
    low, high = chars_per_word
    return [
        Rule("few_words", lambda f: f.n_words < min_words, base=True),
        Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > repeat_percent * f.n_words, base=True),
        Rule("symbols", lambda f: f.n_symbols > f.n_words),
        Rule("dup_lines", lambda f: 100 * f.n_dup_lines > dup_line_percent * f.n_lines),
        Rule("word_length", lambda f: not low * f.n_words <= f.word_chars <= high * f.n_words),
        Rule("bullets", lambda f: 100 * f.n_bullets > bullet_percent * len(f.text_lines)),
        Rule("cut_off", lambda f: 100 * f.n_cut_off > cut_off_percent * len(f.text_lines)),
        Rule("lettered", lambda f: 100 * f.n_lettered < lettered_percent * f.n_words),
        Rule("pairs", lambda f: f.n_words > long_words and 100 * f.top_pair_chars > pair_percent * f.n_chars),
    ]


def estimate(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = 256, sample_chars: int = 100_000) -> dict[str, tuple[float, float]]:
    """{rule: (seconds per text, share rejected)} over ``sample_rows`` texts of ``sample_chars`` at most.

    The sample is every twentieth row, by chance, of the partitions that a scan comes to first (no whole scan
    for an order); it only decides on an order. A rule is charged for its own features alone: what
    all rules need (words, decoded text, lines) is measured before.
    """
    spent, rejected = [0.0] * len(rules), [0] * len(rules)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.length("t") <= sample_chars)
    rows = texts.sample(0.05, seed=7).limit(sample_rows).collect()
    if len(rows) < sample_rows:  # a small table
        rows = texts.limit(sample_rows).collect()
    for row in rows:
        for k, rule in enumerate(rules):
            features = Features(row["t"].encode())
            for shared in ("n_words", "n_lines", "text", "text_lines"):
                getattr(features, shared)
            began = time.perf_counter()
            rejected[k] += rule.rejects(features)
            spent[k] += time.perf_counter() - began
    return {r.name: (s / len(rows), n / len(rows)) for r, s, n in zip(rules, spent, rejected, strict=True)} if rows else {}


def order_rules(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; rules without figures keep their place after the others."""

    def rank(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (1.0, 0.0))
        return -share / max(cost, 1e-9)

    return sorted(rules, key=rank)


def cascade(features: Features, ordered: list[Rule]) -> str | None:
    """Name of the first rule that rejects, or None: later rules are not evaluated."""
    for rule in ordered:
        if rule.rejects(features):
            return rule.name
    return None


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 256, measures: bool = False) -> DataFrame:
    """(id, kept, rejected_by) of every row; with ``measures`` also the base columns of the contract.

    Null and empty texts have no words and are rejected by ``few_words``; null ids are kept as they
    are; repeated rows each get a row; an empty table gives an empty result; other columns are
    ignored. ``rejected_by`` is the first rejecting rule in the measured order, so a text that several
    rules reject may name another one in another run; ``kept`` never changes. With ``measures`` the
    features that the cascade has measured are reused for the base columns; the features of other rules
    are measured only where the cascade comes to them.
    """
    T.prepare(docs.sparkSession)
    rules = default_rules() if rules is None else rules
    ordered = order_rules(rules, estimate(docs, rules, text_col, sample_rows))
    base = [r for r in rules if r.base]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("kept", "rejected_by", "base_failed", *names)}
            for data in T.utf8(batch.column(1)):
                features = Features(data)
                by = cascade(features, ordered)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                if measures:
                    out["base_failed"].append(by is not None and any(r.rejects(features) for r in base))
                for n in names:
                    out[n].append(getattr(features, n))
            if not measures:
                del out["base_failed"]
            columns = {"id": batch.column(0)} | {n: pa.array(v, pa.string() if n == "rejected_by" else pa.bool_() if n in ("kept", "base_failed") else pa.int64()) for n, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, kept boolean, rejected_by string" + ", base_failed boolean" * measures + "".join(f", {n} long" for n in names)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
