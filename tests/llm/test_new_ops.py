"""Centroid clustering, conversation repair and personal data."""

import hashlib
import math
import random
import re
import zlib
from functools import cache
from itertools import product

import numpy as np
from plumbline.llm.centroids import above, assign, below, between, cluster_vectors, shift
from plumbline.llm.private import KINDS, added_spans, barred, base_spans, expectations, find_private, labelled_forms, learn, listed, luhn, padded, plausible, train, viterbi
from plumbline.llm.repair import Repair, repair_conversations
from pyspark.sql import functions as F

# --- centroids


def lloyd(rows, k, rounds, size, scale=1024):
    """Plain rounds with Python integers; rows of (id, vector)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        sides = [nearest(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), s in zip(kept, sides, strict=True) if s == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, s in found if s == c) for c in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, s, d, inertia[s], sum(inertia), marks[s]) for i, d, s in found], key=str)


def test_clusters_equal_plain_rounds(spark):
    rnd = random.Random(5)
    for size, k, n in ((2, 3, 60), (3, 8, 40), (2, 5, 4)):
        grid = [(i, [rnd.randint(-3, 3) / 1024 for _ in range(size)]) for i in range(n)]  # many ties and repeated rows
        odd = [(None, [0.5] * size), (7, [0.25] * size), (7, [0.25] * size), (900, None), (901, [1.0]), (902, [float("nan")] * size), (903, [float("inf"), *[0.0] * (size - 1)]), (904, [None] * size), (905, []), (906, [-100000.5] * size)]
        df = spark.createDataFrame(grid + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("own", F.lit(1)).withColumn("n", F.lit(2))
        got = cluster_vectors(df, k=k, rounds=4, size=size)
        assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(grid + odd, k, 4, size)
    assert cluster_vectors(df.limit(0), size=2).count() == 0


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-40, 40, (300, 64)) + c for c in rng.integers(-2000, 2000, (8, 1, 64))]).astype(np.int32)
    centres = v[rng.choice(len(v), 8, replace=False)].astype(np.int64)
    own, upper, lower, took = np.zeros(len(v), np.int32), np.full(len(v), np.inf, np.float32), np.zeros((len(v), 8), np.float32), 0
    for _ in range(6):
        took += assign(v, own, upper, lower, centres, between(centres))
        true = ((v[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
        assert (own == true.argmin(axis=1)).all()
        assert (lower.astype(float) ** 2 <= true).all() and (upper.astype(float) ** 2 >= true[np.arange(len(v)), own]).all()
        new = np.stack([v[own == c].astype(np.int64).sum(axis=0) // max((own == c).sum(), 1) if (own == c).any() else centres[c] for c in range(8)])
        gone = ((new - centres) ** 2).sum(axis=1)
        shift(own, upper, lower, np.where(gone == 0, np.float32(0), above(gone)))
        centres = new
    assert took < 0.5 * 6 * 8 * len(v)
    squares = rng.integers(0, 1 << 62, 10_000)
    assert all(int(b) ** 2 <= s for b, s in zip(np.floor(below(squares).astype(float)).tolist(), squares.tolist(), strict=True))
    assert all(math.ceil(a) ** 2 >= s for a, s in zip(above(squares).tolist(), squares.tolist(), strict=True))


def test_far_vectors_are_cut_to_the_bound(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["distance"] for r in cluster_vectors(df, k=1, rounds=0, size=2).collect()}
    assert sorted(got.values())[0] == 0 and max(got.values()) in (1 << 56, 1 << 54)


# --- conversations

RIGHT = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Every series of edits, by search over what is said: (cost, audit, lines); turns are (role, text, must go, truncated)."""

    @cache
    def rest(at, last, put=0):
        """Best from turn ``at``; ``last`` is the initial said last ('' for none), after ``put`` turns inserted in a row (more than two are never cheaper)."""
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        found = [(0, "", ())] if at == len(turns) and last in ("", "a") else []
        steps = [(5, "I", to, at, put + 1, f"{to}:") for to in ("user", "assistant") if put < 2]
        if at < len(turns):
            role, text, must_go, cut = turns[at]
            if tail := rest(at + 1, last):
                found.append((tail[0] + 2, "D" + tail[1], tail[2]))
            if not must_go:
                steps += [(price + 5 * cut, letter, to, at + 1, 0, f"{to}:{text}") for letter, price, to in [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]]
        for price, letter, to, then, count, line in steps:
            if to and to[0] in follows and (tail := rest(then, to[0], count)):
                found.append((tail[0] + price, letter + tail[1], (line, *tail[2])))
        return min(found, default=None)

    return rest(0, "")


def test_repairs_equal_a_search_of_all_edits():
    rnd = random.Random(8)
    for _ in range(1500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "ushers", "Assistant"]) if rnd.random() < 0.5 else rnd.choice(["user", "assistant"]), rnd.choice("xyz"), rnd.random() < 0.15, rnd.random() < 0.2) for _ in range(rnd.randint(0, 9))]
        repair = Repair()
        for t in turns:
            repair.turn(*t)
        cost, audit, lines = cheapest(tuple(turns))
        assert repair.result() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), turns
        assert RIGHT.fullmatch("".join(line[0] for line in lines))


def conversation(rows):
    """Figures of one conversation's turns (turn, role, text), ordered."""
    seen, turns, count = set(), [], dict.fromkeys("bdt", 0)
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role, text, fault in ("b", "d"), fault == "t"))
    named = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(tuple(turns))
    gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
    return (gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_conversations_are_damaged_and_repaired(spark):
    rnd = random.Random(9)
    text = lambda: rnd.choice([None, "", " \t\n", "Yes.", "No", "Really? ", "é!", "a\u00a0", "Same."])
    rows = [(rnd.choice([1, 2, 3, None, 77]), rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", None, "", "umpire"]), text()) for _ in range(90)]
    drop = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(drop, 0, "user", "Gone."), (500, 3, "user", "x" * 2_000_000 + "."), (500, 4, "assistant", "y\n" * 500_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("gone", F.lit("x")).withColumn("seen", F.lit(0))
    expected = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, said in rows:
            if c == conv:
                damage = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
                role, said = (" " if role is None else role), (" " if said is None else said)
                said = "" if damage == 1 else re.sub("[.!?]", "", said) if damage == 2 else said
                own += [(turn, "user" if damage == 4 else role, said)] * (0 if damage == 0 else 2 if damage == 3 else 1)
        expected[conv] = conversation(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())))
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == expected and got[drop] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(df.limit(0)).count() == 0


def test_right_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello.")] + [(2, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(3000)]
    got = {r["conv_id"]: r for r in repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damage=False).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KKK") and (got[2]["cost"], got[2]["audit"]) == (0, "K" * 3000)
    said = "\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 2)
    assert got[2]["repaired_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[2]["illegal"] == got[2]["gaps"] == 0


# --- personal data

#: Patterns of the contract as they stand.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    found = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    for _ in range(4000):
        text = "".join(rnd.choice(["@", ".", "a", "b-c", "_", "%", "+", " ", "-", "(", ")", "1", "25", "256", "0", "00255", "4539578763621486", "4539 5787 6362 1486", "\n", "é", "x@y.z"]) for _ in range(rnd.randint(0, 25)))
        assert base_spans(text) == plain_spans(text), text
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "+" + "1 " * 200_000, "@" * 400_000, "a@b." * 100_000):
        assert len(base_spans(text)) < 200_000  # and in time


def test_viterbi_and_expectations_equal_enumeration():
    rng = np.random.default_rng(4)
    for kinds in (1, 2):
        width, shut = 2 * kinds + 1, barred(kinds)
        moves, n = np.where(shut, -1e4, rng.normal(size=(width + 1, width))), np.array([4, 1, 0, 3, 5])
        scores = rng.normal(size=(n.sum(), width)) * 2
        paths, chance, total, went = viterbi(scores, n, moves), [], 0.0, np.zeros((width + 1, width))
        for i, size in enumerate(n):
            own = scores[n[:i].sum() : n[:i].sum() + size]
            ways = {y: sum(own[t, y[t]] + moves[y[t - 1] if t else -1, y[t]] for t in range(size)) for y in product(range(width), repeat=int(size))}
            assert tuple(paths[i]) == max(ways, key=ways.get)
            if size:
                z = sum(math.exp(v) for v in ways.values() if v > -5e3)
                total += math.log(z)
                for y, v in ways.items():
                    if v > -5e3:
                        for t in range(size):
                            went[y[t - 1] if t else -1, y[t]] += math.exp(v) / z
                chance.append(np.array([[sum(math.exp(v) for y, v in ways.items() if y[t] == c and v > -5e3) / z for c in range(width)] for t in range(size)]))
        some = n > 0
        got, moved, logs = expectations(padded(scores, n)[some], n[some], moves)
        assert np.allclose(got[np.arange(got.shape[1])[None] < n[some][:, None]], np.concatenate(chance)) and np.allclose(moved, went) and math.isclose(logs, total)


def test_field_finds_other_ways_to_write(spark):
    field = train(labelled_forms(spark))
    parse = lambda s: [(k, int(a), int(b)) for k, a, b in (x.rsplit(":", 2) for x in s.split(",") if x)]
    held = [(r["text"], parse(r["spans"])) for r in labelled_forms(spark, seed=77).collect()]
    got = added_spans(field, [t for t, _ in held], [[] for _ in held])
    true, found = {(i, s) for i, (_, spans) in enumerate(held) for s in spans}, {(i, s) for i, spans in enumerate(got) for s in spans}
    assert len(true & found) >= 0.95 * len(true) and len(true & found) >= 0.98 * len(found)
    rows = [(1, "Ring (017) 555-7713 or jane [at] mail.example.com now"), (2, None), (3, ""), (None, "plain words only.\nIn 2024, 3.5 of 10, v1.2.3"), (4, "me@b.example, 4539578763621486, 10.0.0.1 and +1 (017) 555-7713"), (4, "me@b.example, 4539578763621486, 10.0.0.1 and +1 (017) 555-7713"), (5, "word " * 300_000 + "a.b@c.de" + " 12 34" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("spans", F.lit(1))
    out = find_private(df, field, redact=True).withColumn("listed", listed("spans")).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 5}
    assert len(out) == 7 and by[1]["redacted"] == "Ring [PHONE] or [EMAIL] now" and not any(s["base"] for s in by[1]["spans"])
    assert by[2]["spans"] == by[3]["spans"] == by[None]["spans"] == [] and by[2]["redacted"] == ""
    assert by[4]["listed"] == "email:0:12,ip:32:40,card:14:30,phone:45:62" and by[4]["redacted"] == "[EMAIL], [CARD], [IP] and [PHONE]"
    assert "email:1500000:1500008" in next(r["listed"] for r in out if r["doc_id"] == 5)
    assert find_private(df.limit(0), field).count() == 0
    empty = train(labelled_forms(spark).limit(0))
    assert all(s["base"] for r in find_private(df, empty).collect() for s in r["spans"])
    other = learn([(f"room {i}-B9", [("room", 5, 5 + len(f"{i}-B9"))]) for i in range(20, 60)])
    assert [k for k, _, _ in added_spans(other, ["in room 33-B9"], [[]])[0]] == ["room"] and plausible("room", "x")
