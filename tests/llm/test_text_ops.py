"""Operators on whole texts against brute force: rules, language model, decontamination, repeats, near copies."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.lm import lm_score
from plumbline.llm.near import _met, near_duplicates, prefix_depth
from plumbline.llm.quality import Features, Rule, cascade, default_rules, order_rules, quality_cascade
from plumbline.llm.repeats import remove_repeats
from plumbline.llm.suffixes import repeated_windows, suffix_order
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def frame(spark, rows):
    """The rows with extra columns whose names clash with internal ones."""
    return spark.createDataFrame(rows, COLUMNS).select("*", F.lit("x").alias("id"), F.lit(1).alias("c"), F.lit(2).alias("key"), F.lit(3).alias("n"))


# --- quality rules


def measures(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "a", "b c\nb c\n\nb c", " ".join(f"w{i}" for i in range(40)), "naïve é " * 20, "# * $ % & | < >" * 3, "x y z\x0bq\x0cr", "one two three four five six " * 3 + "end of it all now", "a b c d e f g h i j\n" * 4 + "k"]


def test_quality_base_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, TEXTS[3])]
    got = rows_of(quality_cascade(frame(spark, rows), measures=True), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for i, t in rows:
        m = measures(t)
        expected.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(expected, key=str)


def test_long_text_finds_the_same_windows():
    text = " ".join(f"w{i % 70_000}" for i in range(70_050))
    features = Features(text.encode())
    assert features.n_repeat_words == 100


def test_costly_rules_are_skipped(spark):
    """The registered rules: a rule's own feature is measured only where the cascade comes to it."""
    rules = default_rules()
    texts = ["word " * 400, "a b", "# $ % & " * 30, "- item one of the list here\n" * 3 + "- x", "Once upon a time there was a long story about nothing much at all, really nothing. " * 1]
    counted = Counter()
    for t in texts:
        features = Features(t.encode())
        cascade(features, rules)
        counted.update(n for n in ("n_repeat_words", "n_symbols", "top_pair_chars", "n_lettered", "n_bullets") if n in vars(features))
    assert counted["n_repeat_words"] == 4 and counted["top_pair_chars"] < counted["n_lettered"] <= counted["n_bullets"] < counted["n_symbols"] == counted["n_repeat_words"] - 1 or counted["n_symbols"] < counted["n_repeat_words"]
    for order in itertools.permutations(rules[2:], 2):
        assert cascade(Features(texts[4].encode()), list(order)) is None


def test_rules_by_hand():
    by = {r.name: r for r in default_rules()}
    rejects = lambda name, t: by[name].rejects(Features(t.encode()))
    assert rejects("bullets", "- a\n\t• b\n") and not rejects("bullets", "- a\nb\n") and not rejects("bullets", "")
    assert rejects("cut_off", "one...\ntwo…\nthree") and not rejects("cut_off", "one.\ntwo\nthree\nfour...")
    assert rejects("lettered", "1 2 3 é x") and not rejects("lettered", "1 2 a b é")
    assert rejects("pairs", "go on " * 60) and not rejects("pairs", "go on " * 20) and not rejects("pairs", " ".join(f"w{i}" for i in range(99)))


def test_order_changes_work_and_not_verdicts(spark):
    rules = default_rules()
    figures = {r.name: (1.0, 0.1 * k) for k, r in enumerate(rules)}
    assert [r.name for r in order_rules(rules, figures)] == [r.name for r in reversed(rules)]
    costly = [Rule("never", lambda f: False), Rule("always", lambda f: True)]
    assert order_rules(costly, {"never": (1.0, 0.0), "always": (0.1, 1.0)})[0].name == "always"
    df = frame(spark, [(i, t) for i, t in enumerate(TEXTS)])
    verdict = lambda rs: rows_of(quality_cascade(df, rs), "doc_id", "kept")
    assert verdict(rules) == verdict(rules[::-1])
    assert quality_cascade(df.limit(0)).count() == 0


# --- language model


def brute_lm(rows, order):
    tokens = lambda t: re.findall(WORD, (t or "").translate({65 + i: 97 + i for i in range(26)})) + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *tokens(t)]
            c["<s>",] += 1
            c.update(tuple(w[k - n + 1 : k + 1]) for k in range(1, len(w)) for n in range(1, order + 1) if k - n + 1 >= 0)
    n, v = sum(x for g, x in c.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in c)

    def p(word, context):
        if not context:
            return (c[word,] + 1) / (n + v + 1)
        lower = p(word, context[1:])
        if not c[context]:
            return lower
        f = max(0.4, (1 + c[context]) ** -0.25)
        return (1 - f) * c[*context, word] / c[context] + f * lower

    out = []
    for i, t in rows:
        w = ["<s>", *tokens(t)]
        score = sum(math.log10(p(w[k], tuple(w[max(0, k - order + 1) : k]))) for k in range(1, len(w)))
        out.append((i, held(i), len(w) - 1, sum(c[x,] > 0 for x in w[1:]), n, round(sum(math.log10(p(x, ())) for x in w[1:]), 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 2000, "parts": 3}, {"order": 1}, {"order": 2}, {"order": 5, "slice_bytes": 1000}])
def test_lm_matches_brute_force(spark, options):
    rnd = random.Random(5)
    vocabulary = ["The", "the", "of", "à", "CAT", "cat", "É", *(f"w{i}" for i in range(20))]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(None, "the cat"), (700, None), (701, ""), (3, "the"), (3, "the")]
    rows += [(800 + i, "the cat of the cat of w1 w2 " + " ".join(rnd.choice(vocabulary[:4]) for _ in range(9))) for i in range(20)] + [(900, "Long words of the cat " * 20_000)]
    found = lm_score(frame(spark, rows), **options)
    got = sorted(((*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in found.collect()), key=str)
    same = lambda xs: [(*x[:5], pytest.approx(x[5], rel=1e-9, abs=2e-6), pytest.approx(x[6], rel=1e-9, abs=2e-6)) for x in xs]
    assert got == same(brute_lm(rows, options.get("order", 3)))
    assert lm_score(frame(spark, rows).limit(0), **options).count() == 0


def test_lm_deals_slices_evenly(spark):
    rows = spark.range(0, 4000, numPartitions=64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 30)).alias("text"))
    answers = lm_score(rows, slice_bytes=3000, parts=64)
    sizes = answers.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(sizes) > 40 and max(r[0] for r in sizes) < 6 * 4000 / 64


# --- decontamination


def brute_contamination(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({65 + i: 97 + i for i in range(26)}))
    windows = []
    for item, t in items:
        w = fold(t)
        if item is not None and w:
            k = min(13, len(w))
            windows.append((str(item), k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}))
    out = []
    for i, t in rows:
        w, hit, names = fold(t), set(), set()
        for name, k, own in windows:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in own:
                    hit.update(range(at, at + k))
                    names.add(name)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_contamination_matches_brute_force(spark, broadcast_bytes):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.choice([3, 12, 13, 14, 40]))) for i in range(12)] + [(50, ""), (51, None), (None, text(20)), (3, text(15)), (60, "Same Words here"), (61, "same, words... HERE")]
    rows = [(i, text(rnd.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, text(20) + " " + t.upper() + "; " + text(5)) for i, (_, t) in enumerate(items) if t]
    rows += [(200, None), (201, ""), (None, items[0][1]), (100, rows[0][1]), (100, rows[0][1]), (300, "x same words here " + text(500)), (301, " ".join(items[4][1].split()[:12]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = decontaminate(frame(spark, rows), benchmark, broadcast_bytes=broadcast_bytes)
    assert rows_of(found, *columns) == brute_contamination(rows, items)
    assert decontaminate(frame(spark, rows).limit(0), benchmark, broadcast_bytes=broadcast_bytes).count() == 0
    assert rows_of(decontaminate(frame(spark, rows), benchmark.limit(0), broadcast_bytes=broadcast_bytes), *columns) == brute_contamination(rows, [])
    carried = decontaminate(frame(spark, rows), benchmark, broadcast_bytes=broadcast_bytes, carry=True).select("row.*")
    assert carried.columns == frame(spark, rows).columns and carried.count() == len(rows)


# --- repeats


def test_suffix_order_and_windows():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, need, length = int(rng.integers(1, 150)), int(rng.integers(1, 40)), int(rng.integers(1, 14))
        data = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint8)
        order, raw = suffix_order(data, need), data.tobytes()
        assert sorted(order) == list(range(n))
        prefixes = [raw[i : i + need] for i in order]
        assert all(a <= b for a, b in itertools.pairwise(prefixes))
        starts, sizes = np.array([0, n // 2]), np.array([n // 2, n - n // 2])
        seen: dict[bytes, list[int]] = {}
        for s, z in zip(starts, sizes, strict=True):
            for i in range(s, s + z - length + 1):
                seen.setdefault(raw[i : i + length], []).append(i)
        assert set(repeated_windows(data, starts, sizes, length).tolist()) == {i for v in seen.values() if len(v) > 1 for i in v}


def brute_repeats(rows, length):
    seen: dict[bytes, list] = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((k, p))
    covered = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                covered[k].update(range(p, p + length))
    out = []
    for (i, t), c in zip(rows, covered, strict=True):
        b = (t or "").encode()
        out.append((i, len(b), len(c), sum(j - 1 not in c for j in c), hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "group_bytes"), [(200, 1_500_000), (24, 1_500_000), (24, 300)])
def test_repeats_match_brute_force(spark, length, group_bytes):
    rnd = random.Random(3)
    words = ["the", "of", "à", "naïve", "cat", "dog", "rain", "sun", "tree", "house", "x"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common, rows = text(60), []
    for i in range(50):
        kind = rnd.random()
        if kind < 0.5:
            rows.append((i, text(rnd.randint(0, 40)) + " " + common + " " + text(rnd.randint(0, 30))))
        elif kind < 0.6:
            rows.append((i, rnd.choice(words) * 60))
        elif kind < 0.7 and rows:
            rows.append((i, rnd.choice(rows)[1]))
        else:
            rows.append((i, text(rnd.randint(0, 80))))
    rows += [(100, None), (101, ""), (102, "abc"), (None, common), (3, rows[3][1]), (3, rows[3][1]), (200, "ab" * 4000)]
    found = remove_repeats(frame(spark, rows), length=length, group_bytes=group_bytes)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, length)


def test_repeats_of_an_empty_table(spark):
    assert remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


# --- near copies


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
            parent[find(a)] = find(b)
            if sets[a] != sets[b]:
                links[a].add(sets[b])
                links[b].add(sets[a])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    out = []
    for k, (i, _) in enumerate(rows):
        if not sets[k]:
            out.append((i, i, i, 1, 0))
            continue
        copies = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[k]]
        out.append((i, least(rows[j][0] for j in range(len(rows)) if find(j) == find(k)), least(copies), len(copies), len(links[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block": 8}, {"block_bytes": 2000}, {"block": 1}])
def test_near_copies_match_brute_force(spark, options):
    rnd = random.Random(5)
    words = [chr(97 + a) + chr(97 + b) for a in range(20) for b in range(10)]
    base, rows = [rnd.choice(words) for _ in range(120)], []
    for i in range(70):
        own = list(base) if i < 40 else [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        if i < 40:
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(120)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
        if rnd.random() < 0.2:
            rows.append((1000 + i, " ".join(own)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "a  b"), (None, " ".join(base)), (3, rows[3][1])]
    found = near_duplicates(frame(spark, rows), **options)
    assert rows_of(found, "doc_id", "class_id", "copy_id", "n_copies", "n_links") == brute_near(rows)


def test_chains_of_unlike_texts_are_verified_prefix_by_prefix(spark):
    """Texts with a common half chain into one component of many blocks; a class is copied to its prefixes' blocks alone."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    shared, rows = [word() for _ in range(104)], []
    for i in range(160):
        own = shared + [word() for _ in range(64)]
        rows.append((i, " ".join(own)))
        if i % 20 == 0:  # one near copy of some
            own[130] = word()
            rows.append((1000 + i, " ".join(own)))
    plain = rows_of(near_duplicates(frame(spark, rows)), "doc_id", "class_id", "copy_id", "n_copies", "n_links")
    assert plain == rows_of(near_duplicates(frame(spark, rows), block=2), "doc_id", "class_id", "copy_id", "n_copies", "n_links") == brute_near(rows)
    assert sum(r[4] for r in plain) == 16


def test_pairs_are_met_once_over_all_trees():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 4, (50, 6)), rng.integers(0, 4, (40, 6))
    one_by_one = [_met(left, right, tree) for tree in range(6)]
    assert (np.sum(one_by_one, axis=0) == _met(left, right, -1)).all() and _met(left, right, -1).any() and not _met(left, right, -1).all()


def test_near_copies_of_an_empty_table_and_depth(spark):
    assert near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert prefix_depth(0.8, 24, 0.99999) == 4
    assert 1 - (1 - 0.8**4) ** 24 >= 0.99999 > 1 - (1 - 0.8**5) ** 24
