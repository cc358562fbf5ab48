"""The classifier against plain arithmetic, and texts far beyond a chunk."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from plumbline.llm.chat import preference_pairs, text_of
from plumbline.llm.classifier import classify, features, fit, train
from plumbline.llm.lm import lm_score
from plumbline.llm.repeats import remove_repeats
from pyspark.sql import functions as F

# --- classifier


def graded(n, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        grade = rnd.choice([0, 1, 2])
        mark = {0: "vile", 1: "dull", 2: "fine"}[grade if rnd.random() < 0.8 else rnd.choice([0, 1, 2])]
        rows.append((i, " ".join([*rnd.sample(words, 8), mark]), grade))
    return rows


def loss(weights, cuts, x, grades, penalty):
    """Mean negative log likelihood of the cumulative links with the penalty, in plain Python."""
    total = 0.0
    for row, y in zip(x, grades, strict=True):
        z = sum(weights.get(k, 0.0) for k in row)
        below = [0.0, *(1 / (1 + math.exp(z - t)) for t in cuts), 1.0]
        total -= math.log(max(below[y + 1] - below[y], 1e-12))
    return total / len(x) + penalty / 2 * sum(w * w for w in weights.values())


def test_fit_comes_near_the_slow_optimum():
    rows = graded(240, 1)
    x = [features([t.encode()])[0] for _, t, _ in rows]
    grades = np.array([g for *_, g in rows])
    model = fit(x, grades, 3, epochs=60, penalty=1e-3, evidence=0.0)
    assert model.thresholds[0] < model.thresholds[1]
    seen = Counter(k for r in x for k in r.tolist())
    used = [[k for k in r.tolist() if seen[k] >= 4] for r in x]
    found = {k: float(model.weights[k]) for r in used for k in r}
    # The reference: whole-batch descent with numeric line steps on the same likelihood.
    names = sorted(found)
    at = {k: i for i, k in enumerate(names)}
    matrix = np.zeros((len(x), len(names)))
    for i, r in enumerate(used):
        matrix[i, [at[k] for k in r]] = 1
    w, t = np.zeros(len(names)), np.array([-0.7, 0.7])

    def value(w, t):
        below = np.column_stack([np.zeros(len(x)), *(1 / (1 + np.exp(matrix @ w - c)) for c in t), np.ones(len(x))])
        return -np.log(np.maximum(below[range(len(x)), grades + 1] - below[range(len(x)), grades], 1e-12)).mean() + 1e-3 / 2 * w @ w

    for _ in range(400):
        below = np.column_stack([np.zeros(len(x)), *(1 / (1 + np.exp(matrix @ w - c)) for c in t), np.ones(len(x))])
        slope, p = below * (1 - below), np.maximum(below[range(len(x)), grades + 1] - below[range(len(x)), grades], 1e-12)
        up = (slope[range(len(x)), grades + 1] - slope[range(len(x)), grades]) / p / len(x)
        dw = matrix.T @ up + 1e-3 * w
        dt = np.array([((slope[:, j + 1] / p) * ((grades == j + 1).astype(float) - (grades == j))).sum() for j in range(2)]) / len(x)
        step = 4.0
        while step > 1e-6 and value(w - step * dw, t - step * dt) > value(w, t):
            step /= 2
        w, t = w - step * dw, t - step * dt
    best = value(w, t)
    mine = loss(found, model.thresholds.tolist(), used, grades.tolist(), 1e-3)
    flat = value(np.zeros(len(names)), np.log(np.array([(grades == 0).mean(), (grades <= 1).mean()]) / (1 - np.array([(grades == 0).mean(), (grades <= 1).mean()]))))
    assert math.isclose(loss(dict(zip(names, w.tolist(), strict=True)), t.tolist(), used, grades.tolist(), 1e-3), best, rel_tol=1e-9)
    assert best - 1e-6 <= mine <= best + 0.1 * (flat - best)  # nine tenths of the way at least


def test_classify_is_plain_arithmetic(spark):
    rows = graded(150, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "fine fine")], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"))
    weights = model.weights.astype(np.float32)
    text_of_row = {i: t for i, t, _ in rows} | {900: "", 901: "", None: "fine fine"}
    for r in classify(docs, model).collect():
        z = sum(float(weights[k]) for k in features([text_of_row[r["doc_id"]].encode()])[0].tolist())
        tails = [1 / (1 + math.exp(-(z - c))) for c in model.thresholds.tolist()]
        assert math.isclose(r["expected_grade"], sum(tails), abs_tol=1e-5) and math.isclose(r["p_top"], tails[-1], abs_tol=1e-5) and r["kept"] == (r["p_top"] >= 0.5)


# --- very long texts


def test_long_texts_are_scored_whole(spark):
    rnd = random.Random(4)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:6]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    texts = {i: " ".join(f"w{rnd.randrange(50)}" for _ in range(20)) for i in ids[1:]} | {ids[0]: " ".join(f"w{rnd.randrange(3000)}" for _ in range(300_000)), held: " ".join(f"w{rnd.randrange(3500)}" for _ in range(250_000))}
    got = {r["doc_id"]: r for r in lm_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    count = Counter(w for i in ids for w in [*texts[i].split(), None])
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        tokens = [*t.split(), None]
        assert got[i]["n_tokens"] == len(tokens) and got[i]["n_known"] == sum(w in count for w in tokens) and got[i]["train_tokens"] == n
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)


def test_repeats_cross_chunks(spark):
    rnd = random.Random(5)
    prose = lambda n, letters: "".join(rnd.choices(letters, k=n))
    shared = prose(400_000, "abcdefgh")  # longer than any chunk's rest, so it lies over the edge of one
    one = prose(900_000, "ijklmnop") + "X" + shared + "X" + prose(300_000, "ijklmnop")
    two = prose(300_000, "qrstuvw") + "Y" + shared + "Y" + prose(1_000_000, "qrstuvw")
    df = spark.createDataFrame([(1, one), (2, two), (3, "short"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    for k, text in ((1, one), (2, two)):
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"]) == (len(text), len(shared), 1)
        assert got[k]["kept_sha256"] == hashlib.sha256(text.replace(shared, "").encode()).hexdigest()
    assert got[3]["n_removed"] == got[4]["n_bytes"] == 0


def test_long_turns_are_rendered_whole(spark):
    long = "é" * 1_000_000
    rows = [(0, 0, "user", long), (0, 1, "assistant", long + "A"), (1, 0, "user", long), (1, 1, "assistant", long + "B")]
    pairs = preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), pair=F.floor(F.col("conv_id") / 2), chosen=F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    (r,) = pairs.select("n_prompt_turns", "prompt", text_of("chosen").alias("c"), text_of("rejected").alias("r")).collect()
    assert r["n_prompt_turns"] == 1 and r["prompt"].count("é") == 1_000_000 and f"{long}A<" in r["c"] and f"{long}B<" in r["r"]
