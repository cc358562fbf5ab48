"""Personal data: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The patterns give the base spans. The field labels tokens as outside, at the beginning of or inside a span of
a kind; its features are shapes of words in a window, and its weights are learned from a small labelled table
by maximum likelihood. Only places near a digit or an at sign are decoded, as every span holds one of them;
sequences of many texts go through Viterbi together, one NumPy step for each position. A span that the field
adds must have the digits of its kind and may not touch a base span.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import text as T

#: Kinds in their order, and the patterns of base spans. Fixed values of the contract.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
# A start inside a run that failed would fail again, so each run is tried once, from its beginning.
_EMAIL = rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE, EMAIL = re.compile(_EMAIL), re.compile(rf"(?<![{_LOCAL}]){_EMAIL}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rows of the labelled table that training takes at most: those with the least hash of their text.
LABELLED_ROWS = 2_000
#: What makes a place worth decoding, and how many characters around it are read.
TRIGGER, AROUND = re.compile(r"[0-9@]|(?i:[(\[{]\s?at\s?[)\]}])"), 48
_AT, _DOT = re.compile(r"@|(?i:[(\[{]\s?at\s?[)\]}])"), re.compile(r"\.|(?i:[(\[{]\s?dot\s?[)\]}])")
TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|\S")
#: Cells (sequences x positions) that Viterbi takes at a time, unless one sequence has more.
CELLS = 1 << 18


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plausible(kind: str, text: str) -> bool:
    """Whether a match has the signs or digits of its kind; kinds other than the four have no rule."""
    if kind == "email":
        return bool(_AT.search(text)) and bool(_DOT.search(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in parts)
    if kind in ("card", "phone"):
        low, high = (13, 19) if kind == "card" else (9, 15)
        digits = _digits(text)
        return low <= len(digits) <= high and (kind == "phone" or luhn(digits))
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns in order of kind and start; time is in proportion to the text."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        at = 0
        while m := EMAIL_HERE.match(text, at) or EMAIL.search(text, at):
            found.append(("email", *m.span()))
            at = m.end()
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if plausible(kind, m.group())]
    return found


# --- tokens and features


@lru_cache(1 << 16)
def _marks(token: str) -> tuple[int, int]:
    """Hashes of a token's shape and of a word of letters (0 for others)."""
    if token.isascii() and token.isdigit():
        return xxhash.xxh3_64_intdigest(f"d{min(len(token), 20)}"), 0
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z\x80-\U0010ffff]+", "a", re.sub(r"[0-9]+", "0", token)))
    word = token.lower() if token.isalpha() and len(token) <= 12 else ""
    return xxhash.xxh3_64_intdigest(shape[:12]), xxhash.xxh3_64_intdigest("w" + word) if word else 0


def places(text: str) -> list[tuple[int, int]]:
    """Stretches of one line around all triggers, joined where they meet, from space to space."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() + AROUND <= out[-1][1]:
            continue
        low, high = max(m.start() - AROUND, 0), min(m.end() + AROUND, len(text))
        low = max(low, text.rfind("\n", low, m.start()) + 1)
        cut = text.find("\n", m.end(), high)
        high = high if cut < 0 else cut
        if out and low <= out[-1][1] and "\n" not in text[out[-1][1] : m.start()]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def tokens(text: str, low: int, high: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the tokens of a stretch."""
    spans = [m.span() for m in TOKEN.finditer(text, low, high)]
    return [a for a, _ in spans], [b for _, b in spans]


#: Features: offsets of shapes (with whether a space goes before), then of words, that are looked at together.
SHAPES = [(0,), (-1,), (1,), (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (-2, -1, 0, 1), (-1, 0, 1, 2), (-2, -1, 0, 1, 2), (-3, -2, -1, 0), (0, 1, 2, 3)]
WORDS = [(0,), (-1,), (1,)]
_PAD = 3


def features(sequences: list[list[tuple[int, int, bool]]]) -> np.ndarray:
    """(tokens, features): hashes of the features of every token; sequences of (shape, word, space before) follow each other."""
    size = sum(len(s) + _PAD for s in sequences) + _PAD
    shape, word, inner, at = np.full(size, 7, np.uint64), np.full(size, 7, np.uint64), np.zeros(size, bool), _PAD
    for s in sequences:
        if s:
            shape[at : at + len(s)] = [h ^ (0x9E37 if g else 0) for h, _, g in s]
            word[at : at + len(s)] = [w for _, w, _ in s]
            inner[at : at + len(s)] = True
        at += len(s) + _PAD
    own = np.flatnonzero(inner)
    columns = []
    for k, (source, offsets) in enumerate([(shape, o) for o in SHAPES] + [(word, o) for o in WORDS]):
        h = np.full(len(own), k + 1, np.uint64)
        for o in offsets:
            h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + source[own + o])
        columns.append(h)
    return np.stack(columns, axis=1) if columns else np.zeros((0, 0), np.uint64)


# --- the field


@dataclass
class Field:
    """Labels (outside, then beginning and inside of each kind), known features and their weights, transitions."""

    kinds: list[str]
    keys: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, hashes: np.ndarray) -> np.ndarray:
        """(tokens, labels): sums of the weights of known features."""
        labels = 2 * len(self.kinds) + 1
        if not len(self.keys) or not len(hashes):
            return np.zeros((len(hashes), labels))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return (self.weights[at] * (self.keys[at] == hashes)[..., None]).sum(axis=1)


def barred(kinds: int) -> np.ndarray:
    """(labels + 1, labels): what can't follow; the last row is the start. Inside follows its own kind alone."""
    labels = 2 * kinds + 1
    out = np.zeros((labels + 1, labels), bool)
    for k in range(kinds):
        out[:, 2 * k + 2] = True
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = False
    return out


def padded(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(sequences, positions, labels) of scores that follow each other, 0 beyond the ends."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0)), scores.shape[1]))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = scores
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence (ties: the smaller label); sequences of like lengths are decoded together."""
    starts, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto - at + 1) * lengths[order[upto]] <= CELLS:
            upto += 1
        batch = order[at:upto]
        rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in batch])
        s, n = padded(scores[rows], lengths[batch]), lengths[batch]
        back = np.zeros(s.shape, np.int8)
        if s.shape[1]:
            best = s[:, 0] + moves[-1]
            for t in range(1, s.shape[1]):
                reach = best[:, :, None] + moves[None, :-1]
                back[:, t] = reach.argmax(axis=1)
                live = (t < n)[:, None]
                back[:, t] = np.where(live, back[:, t], np.arange(s.shape[2]))
                best = np.where(live, reach.max(axis=1) + s[:, t], best)
            path, last = np.zeros(s.shape[:2], np.int64), best.argmax(axis=1)
            for t in range(s.shape[1] - 1, -1, -1):
                path[:, t] = last
                last = back[np.arange(len(batch)), t, last]
        for k, i in enumerate(batch):
            out[i] = path[k, : n[k]] if n[k] else out[i]
        at = upto
    return out


def expectations(s: np.ndarray, n: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward over padded scores: label probabilities, expected moves, sum of log partition functions.

    Both passes are rescaled at every position, so they are products of small matrices.
    """
    size, top = s.shape[1], s.max(axis=2, keepdims=True)
    psi, start, step = np.exp(s - top), np.exp(moves[-1]), np.exp(moves[:-1])
    ahead, after, scale = np.zeros(s.shape), np.ones(s.shape), np.ones(s.shape[:2])
    for t in range(size):
        reach = (ahead[:, t - 1] @ step if t else start) * psi[:, t]
        scale[:, t] = reach.sum(axis=1)
        ahead[:, t] = reach / scale[:, t, None]
    pulled = psi / scale[..., None]
    for t in range(size - 2, -1, -1):
        after[:, t] = np.where((t + 1 < n)[:, None], (pulled[:, t + 1] * after[:, t + 1]) @ step.T, 1)
    inner = np.arange(size)[None, :] < n[:, None]
    chance = ahead * after * inner[..., None]
    went = np.zeros(moves.shape)
    went[-1] = chance[:, 0].sum(axis=0)
    for t in range(1, size):
        went[:-1] += step * (ahead[t < n, t - 1].T @ (pulled[t < n, t] * after[t < n, t]))
    return chance, went, float(((np.log(scale) + top[..., 0]) * inner).sum())


def fit(hashes: list[np.ndarray], labels: list[np.ndarray], kinds: list[str], *, steps: int = 80, rate: float = 0.2, penalty: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty by Adam over all sequences."""
    width, shut = 2 * len(kinds) + 1, barred(len(kinds))
    kept = [i for i, y in enumerate(labels) if len(y)]
    if not kept:
        return Field(kinds, np.zeros(0, np.uint64), np.zeros((0, width)), np.where(shut, -1e4, 0.0))
    n, flat, y = np.array([len(labels[i]) for i in kept]), np.concatenate([hashes[i] for i in kept]), np.concatenate([labels[i] for i in kept])
    keys, at = np.unique(flat, return_inverse=True)
    at = at.reshape(flat.shape)
    order = np.argsort(at.ravel(), kind="stable")
    token, begins = order // at.shape[1], np.searchsorted(at.ravel()[order], np.arange(len(keys)))
    inner = np.arange(n.max())[None, :] < n[:, None]
    first = np.cumsum(n) - n
    seen_moves = np.zeros((width + 1, width))
    np.add.at(seen_moves, (np.where(np.isin(np.arange(len(y)), first), width, np.roll(y, 1)), y), 1)
    weights, moves = np.zeros((len(keys), width)), np.zeros((width + 1, width))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        allowed = np.where(shut, -1e4, moves)
        chance, went, _ = expectations(padded(weights[at].sum(axis=1), n), n, allowed)
        off = chance[inner]
        off[np.arange(len(y)), y] -= 1
        slopes = [np.add.reduceat(off[token], begins, axis=0) + penalty * weights, np.where(shut, 0, went - seen_moves) + penalty * moves]
        for k, (value, slope) in enumerate(zip((weights, moves), slopes, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(kinds, keys, weights, np.where(shut, -1e4, moves))


def sequence(text: str, starts: list[int], ends: list[int]) -> list[tuple[int, int, bool]]:
    return [(*_marks(text[a:b]), k > 0 and a > ends[k - 1]) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def learn(rows: list[tuple[str, list[tuple[str, int, int]]]], **how) -> Field:
    """The field of labelled texts (text, spans)."""
    kinds = KINDS + sorted({k for _, spans in rows for k, _, _ in spans} - set(KINDS))
    hashes, labels = [], []
    for text, spans in rows:
        starts, ends = tokens(text, 0, len(text))
        y = np.zeros(len(starts), np.int64)
        for kind, low, high in spans:
            inside = [k for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if a >= low and b <= high]
            y[inside] = 2 * kinds.index(kind) + 2
            y[inside[:1]] = 2 * kinds.index(kind) + 1
        hashes.append(features([sequence(text, starts, ends)]))
        labels.append(y)
    return fit(hashes, labels, kinds, **how)


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text that the field adds to the base spans, in order of kind and start."""
    owner, found, sequences = [], [], []
    for i, text in enumerate(texts):
        for low, high in places(text):
            starts, ends = tokens(text, low, high)
            owner.append(i)
            found.append((starts, ends))
            sequences.append(sequence(text, starts, ends))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if sequences:
        paths = viterbi(field.scores(features(sequences)), np.array([len(s) for s in sequences]), field.moves)
        for i, (starts, ends), path in zip(owner, found, paths, strict=True):
            begins = np.flatnonzero(path % 2 == 1)
            for b in begins.tolist():
                e = b + 1
                while e < len(path) and path[e] == path[b] + 1:
                    e += 1
                span = (field.kinds[path[b] // 2], starts[b], ends[e - 1])
                if plausible(span[0], texts[i][span[1] : span[2]]) and not any(a < span[2] and span[1] < z for _, a, z in base[i]):
                    out[i].append(span)
        for spans in out:
            spans.sort(key=lambda s: (field.kinds.index(s[0]), s[1]))
    return out


# --- Spark


def train(labelled: DataFrame, *, text_col: str = "text", spans_col: str = "spans", most: int = LABELLED_ROWS, **how) -> Field:
    """Fit on a labelled table: texts and their spans as text, ``kind:start:end`` comma-joined (null: none).

    At most ``most`` rows are used, those with the least hash of their text, in one bounded task; null texts
    are left out and repeated rows count once. Without rows the field adds nothing.
    """
    T.prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.coalesce(spans_col, F.lit("")).alias("spans")).where(F.col("text").isNotNull()).distinct()
    rows = rows.withColumn("h", F.xxhash64("text")).orderBy("h", "text", "spans").limit(most).select("text", "spans")

    def run(batches):
        found = sorted({r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
        parsed = [(t, [(k, int(a), int(b)) for k, a, b in (x.rsplit(":", 2) for x in s.split(",") if x)]) for t, s in found]
        if parsed:
            field = learn(parsed, **how)
            yield pa.RecordBatch.from_pydict({"kinds": [field.kinds], "keys": [field.keys.tobytes()], "weights": [field.weights.astype(np.float32).tobytes()], "moves": [field.moves.tobytes()]})

    made = rows.repartition(1).mapInArrow(run, "kinds array<string>, keys binary, weights binary, moves binary").collect()  # one row
    if not made:
        return learn([])
    kinds, keys, weights, moves = made[0]
    width = 2 * len(kinds) + 1
    return Field(list(kinds), np.frombuffer(keys, np.uint64), np.frombuffer(weights, np.float32).reshape(-1, width), np.frombuffer(moves).reshape(-1, width))


def find_private(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id, spans) of each row: an array of (kind, start, end, base), by kind as listed, then start.

    Places are code points, the end exclusive; ``base`` tells the fixed patterns from what the field adds.
    With ``redact`` a column ``redacted`` has the text with each stretch of spans replaced by its first kind in
    brackets. Null and empty texts have no span; texts of any length are read whole; null and repeated ids
    each get their row; an empty table gives an empty result; other columns are ignored. There is no shuffle;
    the broadcast field is bounded by the rows of its training.
    """
    T.prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((field.kinds, field.keys, field.weights, field.moves))

    def run(batches):
        own = Field(*shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            extra = added_spans(own, texts, base)
            rank = {k: i for i, k in enumerate(own.kinds)}
            spans = [sorted([(k, a, z, True) for k, a, z in b] + [(k, a, z, False) for k, a, z in e], key=lambda s: (rank[s[0]], s[1])) for b, e in zip(base, extra, strict=True)]
            listed = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in row] for row in spans]
            columns = {"id": batch.column(0), "spans": pa.array(listed, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))}
            if redact:
                columns["redacted"] = pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)])
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, spans array<struct<kind string, start bigint, end bigint, base boolean>>" + (", redacted string" if redact else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` without its spans; spans that touch or overlap are one stretch."""
    out, at = [], 0
    for kind, low, high, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if low >= at:
            out += [text[at:low], f"[{kind.upper()}]"]
        at = max(at, high)
    return "".join([*out, text[at:]])


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- the small labelled table

#: Ways to write each kind: # a digit, w a word, W a name, b a number up to 255, L digits of a card number (the check digit fits).
FORMS = {
    "email": ["w.##@w#.w.w", "w@w.w", "w.w@w.w", "W.W@w-w.w", "w_##@w.w.w", "w (at) w.w", "w.w (at) w.w", "w [at] w [dot] w", "w(at)w(dot)w", "w [at] w.w.w", "w.## [at] w#.w.w", "w @ w.w", "w.## @ w#.w.w", "w.w @ w.w.w"],
    "ip": ["b.b.b.b", "b.b.b.b", "b . b . b . b", "b[.]b[.]b[.]b", "b.b.b[.]b"],
    "card": ["LLLLLLLLLLLLLLLL", "LLLL LLLL LLLL LLLL", "LLLL-LLLL-LLLL-LLLL", "LLLL.LLLL.LLLL.LLLL", "LLLL  LLLL  LLLL  LLLL", "LLLL/LLLL/LLLL/LLLL", "LLLL LLLLLL LLLLL", "LLLL - LLLL - LLLL - LLLL"],
    "phone": ["+# (###) ###-####", "(###) ###-####", "1 (###) ###-####", "###-###-####", "###.###.####", "+## ## #### ####", "+##-###-#######", "0## #### ####", "00## ### ### ####", "+# ### ### ####", "(###) ### ####", "(0###) ######", "###/###-####", "+##(#)## ### ####"],
}
#: Ways to write what is no personal data.
OTHERS = [
    "#.#", "#.#.#", "v#.#.##", "w #.#.", "version #.", "####-##-##", "##/##/####", "##.##.####", "##:##", "##:##:##", "$##.##", "#,###.##", "##%", "####", "##", "#", "#####", "######", "#########", "############", "####-####",
    "##-##", "#/#", "###-#-###-#####-#", "No. ####", "@w", "@w_##", "w@", "# @ $#.##", "x[##] = ##", "w=h", "w = \"h\"", "h", "\"h\"", "##+##=##", "##.####, -##.####", "w-###-####", "####/##", "w##", "#w#", "AKIAW#W#", "(##)", "[##]", "(####)",
    "#. #. #. #.", "## ## ##", "#, #, #", "## x ##", "#e-##", "####.##.##", "#.#.#.#.#.#", "#th", "##kg", "ISBN ###-#-##-######-#", "§ ##.#", "w/##", "#:#-#", "###,###,###", "-##.#", "##°", "w:####", "(w) w", "w [w] w", "look (at) it",
]
_AROUND = ["{}", "w {} w", "w w {} w w", "W w w {}.", "w w, {}, w w", "w: {}", "w = {};", "({})", "w w {}%%% w", "w*** {}### w w", "| w | {} | w |", "\"{}\" w w", "w w w {}!", "<{}>", "w {}, w {}"]


def _fill(form: str, rnd: random.Random) -> str:
    """A form with its letters drawn; words of the forms themselves stay."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéèüöñ") if rnd.random() < 0.1 else rnd.choice("aeionrstlh") for _ in range(rnd.randint(1, 9)))
    plain = lambda: "".join(rnd.choice("aeionrstlhdmc") for _ in range(rnd.randint(2, 9)))
    n = form.count("L")
    if n:
        digits = [rnd.choice("123456789"), *(rnd.choice("0123456789") for _ in range(n - 2))]
        card = "".join(digits) + next(d for d in "0123456789" if luhn("".join(digits) + d))
    out, at = [], 0
    for m in re.finditer(r"[A-Za-z]+|.", form, re.S):
        piece = m.group()
        if set(piece) == {"L"}:
            out.append(card[at : at + len(piece)])
            at += len(piece)
        else:
            draw = {"#": lambda: rnd.choice("0123456789"), "w": plain if "@" in form or "at" in form else word, "W": lambda: plain().capitalize(), "b": lambda: str(rnd.randint(0, 255)), "h": lambda: "%x" % rnd.getrandbits(rnd.choice([48, 64, 128, 160]))}
            out.append(draw[piece]() if piece in draw else piece)
    return "".join(out)


def labelled_forms(spark: SparkSession, *, each: int = 6, seed: int = 13) -> DataFrame:
    """(text, spans): a small labelled table, ``each`` texts of every way to write personal data or something like it."""
    rnd, rows = random.Random(seed), []
    ways = [(kind, form) for kind, forms in FORMS.items() for form in forms] + [(None, form) for form in OTHERS]
    for kind, form in ways:
        for k in range(each):
            frame = _AROUND[(k * 7 + len(rows)) % len(_AROUND)]
            text, spans = "", []
            for i, part in enumerate(frame.split("{}")):
                if i:
                    value = _fill(form, rnd)
                    if kind:
                        spans.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
                    text += value
                text += re.sub(r"[wW]", lambda m: _fill(m.group(), rnd), part)
            rows.append((text, ",".join(spans)))
    return spark.createDataFrame(rows, "text string, spans string")
