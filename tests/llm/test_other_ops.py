"""Mixing, archives, pages, chat formatting, the classifier and the pipeline."""

import hashlib
import random
import time
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pytest
from plumbline.llm import warc
from plumbline.llm.chat import mask_of, preference_pairs, text_of
from plumbline.llm.classifier import classify, features, fit, train
from plumbline.llm.html import blocks, extract_main_text
from plumbline.llm.mixing import Mix, exact_weights, mix_sources, schedule, slots
from pyspark.sql import functions as F

# --- mixing


def test_frames_stay_within_one_block():
    rnd = random.Random(1)
    for _ in range(100):
        weights = {f"s{i}": rnd.randint(1, 30) for i in range(rnd.randint(1, 12))}
        total, got = sum(weights.values()), Counter()
        for t, (source, block) in enumerate(islice(slots(weights), 3 * total), 1):
            assert block == got[source]
            got[source] += 1
            assert all(abs(got[s] - t * w / total) < 1 for s, w in weights.items())
        assert got == Counter({s: 3 * w for s, w in weights.items()})


def rows_of(mix, most=10**9):
    return [(s, int(b), int(t), p) for names, blocks, at, p in mix.run(most) for s, b, t in zip(names, blocks, at, strict=True)]


def test_runs_fill_every_slot_once_and_go_on_from_anywhere(spark, monkeypatch):
    rnd = random.Random(2)
    for trial in range(60):
        weights = {f"s{i}": rnd.randint(1, 20) for i in range(rnd.randint(1, 8))}
        blocks = {s: rnd.randint(0, 60) for s in weights}
        whole = rows_of(Mix(blocks, weights))
        assert [t for _, _, t, _ in whole] == list(range(sum(blocks.values()))) and {(s, b) for s, b, _, _ in whole} == {(s, b) for s, n in blocks.items() for b in range(n)}
        with monkeypatch.context() as m:  # frames as arrays or slot by slot
            m.setattr("plumbline.llm.mixing.FRAME", 0)
            assert rows_of(Mix(blocks, weights)) == whole
        mix, parts = Mix(blocks, weights), []
        while mix.slot < len(whole):
            parts += rows_of(mix, rnd.randint(1, 15))
        assert parts == whole
        if trial < 3:  # pieces that tasks write
            got = schedule(spark, blocks, weights, piece=7).collect()
            assert sorted((r["s"], r["block"], r["slot"], r["phase"]) for r in got) == sorted(whole)


def test_long_schedules_hold_no_slots():
    weights = exact_weights({f"s{k}": 2.0**0.5 * (k + 1) ** 0.5 for k in range(5)})
    began, seen, peak = time.perf_counter(), 0, 0
    for names, own, _, _ in Mix(dict.fromkeys(weights, 60_000), weights).run(10**9):
        seen, peak = seen + len(own), max(peak, len(names))
    assert seen == 300_000 and peak <= 1 << 16 and time.perf_counter() - began < 30


def test_mix_places_every_row(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(None, "a"), (7, "a"), (7, "a"), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("x")).withColumn("id", F.lit(1))
    out = mix_sources(df, {"a": 3, "b": 1}, block_rows=4).collect()
    assert sorted(((r["doc_id"], r["source"]) for r in out), key=str) == sorted(rows, key=str)
    assert len({r["position"] for r in out}) == len(rows)
    first = Counter(s for s, _ in {(r["source"], r["slot"]) for r in out if r["phase"] == 0})
    slots = {r["slot"] for r in out if r["phase"] == 0}
    weights = {"a": 3, "b": 1, None: 1}
    for source, n in first.items():
        assert abs(n - len(slots) * weights[source] / 5) < 1
    assert mix_sources(df.limit(0)).count() == 0


def test_exact_weights_do_not_drift(spark):
    weights = {"+a": 1 / 3, "+b": 2**0.5, "+c": 1.0}
    got, total = Counter(), sum(weights.values())
    for t, (s, _) in enumerate(islice(slots(exact_weights(weights)), 60_000), 1):
        got[s] += 1
        assert all(abs(got[k] - t * w / total) < 1 for k, w in weights.items())
    assert exact_weights({"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}
    for bad in (0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            exact_weights({"a": bad})


def test_mix_takes_any_number_of_sources(spark):
    df = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 12_000).alias("source"))
    out = mix_sources(df, block_rows=1)
    assert out.count() == out.select("position").distinct().count() == 25_000 and out.agg(F.max("position")).first()[0] == 24_999


# --- archives


def test_archives_come_back(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", ""), (4, "u", None), (5, "é", "é<b>"), (6, "v", "\r\n\r\n" * 50), (None, "n", "same"), (1, "again", "same"), (9, "w", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("digest", F.lit("y"))
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=500)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    by_digest: dict[str, list] = {}
    for i, _, h in rows:
        by_digest.setdefault(warc.sha1_base32((h or "").encode()), []).append(i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(x for x in by_digest[warc.sha1_base32(data)] if x is not None)
        expected.append((str(i) if i is not None else None, len(data), warc.sha1_base32(data), "response" if i == first else "revisit", None if i == first else str(first)))
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=str) == sorted(expected, key=str)
    assert all(hashlib.sha1(r["payload"]).digest() and warc.sha1_base32(bytes(r["payload"])) == r["payload_digest"] for r in got if r["record_type"] == "response")
    small = warc.write_archives(df, f"file://{tmp_path}/m", min_payload=5)
    assert Counter(r["record_type"] for r in warc.read_archives(small).collect())["revisit"] == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_damage_is_found():
    record = warc.record(1, "u", b"payload", warc.sha1_base32(b"payload"), None)
    assert warc.http_payload(*warc.parse(record)) == (7, b"payload")
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload", b"paylode"))
    with pytest.raises(ValueError):
        warc.parse(record[:-3])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = press.compress(record) + press.flush()

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            piece, self.data = self.data[:1], self.data[1:]
            return piece

    assert list(warc.members(Stream(member * 2))) == [record, record]
    with pytest.raises(ValueError):
        list(warc.members(Stream(member[:-4])))


# --- pages

PAGE = """<html><head><title>T</title><script>var a="</p><article>x</article>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One<br>two &lt;b&gt;
 three<p>Four <b>bold</b></p><div class="share">Share</div><!-- no --><form>Send</form><section id="comments"><p>Nice!</p></section></article><aside>Side</aside><footer>Foot</footer></body></html>"""


def kept(page):
    return [t for t, keep, *_ in blocks(page) if keep]


def test_blocks_of_an_article():
    assert kept(PAGE) == ["Head & line", "One two <b> three", "Four bold"]
    assert blocks("") == [] and kept("<nav>x") == [] and blocks("plain") == [("plain", True, False, False)]
    assert blocks("<script>x") == [] and kept("<p>a<p>b") == ["a", "b"] and kept("a < b, c <d") == ["a < b, c <d"]
    assert kept("<b>x<article><p>y</b> z</p></article>") == ["y z"]


def test_marks_keep_headings_and_most_of_the_text():
    assert kept('<article><div class="entry-header"><h1>Title</h1></div><p>text</p></article>') == ["Title", "text"]
    assert kept('<article><div class="page-banner"><h1>Title</h1></div><p>text</p></article>') == ["Title", "text"]
    assert kept('<main><div class="elementor-widget"><p>Body text</p></div></main>') == ["Body text"]
    assert kept('<main><div class="with sidebar"><p>Body text of some length</p><div class="comments">I agree</div></div><p>end</p></main>') == ["Body text of some length", "end"]
    assert kept('<main><p>One two three</p><p class="search-result">found</p><p class="legal-notice">law</p><p id="ad">buy</p><p role="navigation">up</p><p hidden>h</p><div style="display: none">n</div></main>') == ["One two three", "found"]
    assert kept("<article><p>text</p><form>Send</form><aside>by</aside><footer>end</footer><header>top</header></article>") == ["text", "top"]


LONG = "Ants live together in colonies of many thousands, and each of them knows what its sisters did an hour before."


def test_names_nominate_and_make_up_decides():
    article = lambda inner: f"<article><h1>Ants</h1><p>{LONG} They build.</p>{inner}</article>"
    rest = lambda inner: kept(article(inner))[2:]
    # Prose under a suspicious name stays; it is only nominated for the host's repetition.
    assert rest(f'<section id="social"><h2>Social life of ants</h2><p>{LONG}</p></section>') == ["Social life of ants", LONG]
    assert rest('<section id="social"><h2>Social life of ants</h2><p>They share all that they find.</p></section>') == ["Social life of ants", "They share all that they find."]
    assert rest(f'<div class="post-share"><p>{LONG}</p></div>') == [LONG]
    assert [s for _, _, _, s in blocks(article(f'<div class="post-share"><p>{LONG}</p></div><p>own</p>'))] == [False, False, True, False]
    # Furniture goes: links, controls, or nothing like a sentence; comments go whatever they are made of.
    assert rest(f'<div class="related"><p>{" ".join(f"<a href=x>{w}</a>" for w in LONG.split())}</p></div>') == []
    assert rest(f'<div class="newsletter"><p>{LONG}</p><input name="mail"></div>') == rest('<div class="cookie-notice">We use cookies on this site</div>') == []
    assert rest(f'<section id="comments"><h2>What readers say</h2><p>{LONG}</p></section>') == []
    # An element that its name drops is opened where it holds the article or most of the text.
    assert kept(f"<body><form id=aspnet><nav><a>Home</a></nav><article><h1>Ants</h1><p>{LONG}</p></article><input></form></body>") == ["Ants", LONG]
    assert kept(f"<body><form><h1>Ants</h1><p>{LONG}</p><p>{LONG} Again.</p></form><p>Elsewhere</p></body>") == ["Ants", LONG, f"{LONG} Again.", "Elsewhere"]
    assert kept(f"<article><p>{LONG}</p><form><p>Your name please</p><input></form></article>") == [LONG]
    # A line of rights is no main text where no article bounds it.
    assert kept(f"<div><p>{LONG}</p></div><div>Copyright 2020</div><div>&copy; 2020 Ants Ltd</div>") == [LONG]
    assert kept(f"<div><h1>Copyright law of ants</h1><p>Copyright is {LONG}</p></div>")[-1] == f"Copyright is {LONG}"


def test_repetition_decides_on_nominated_prose(spark):
    rnd = random.Random(21)
    prose = lambda n=60: " ".join(f"w{rnd.randrange(99_999)}" for _ in range(n))
    notice, own, asides = prose(25), [prose() for _ in range(8)], [prose(25) for _ in range(8)]
    said = lambda k: notice if k < 4 else asides[k]
    rows = [(k, "http://h/", f'<nav><a>{prose(3)}</a></nav><article><h1>T{k}</h1><p>{t}</p><div class="site-notice"><p>{said(k)}</p></div><p>{t[:40].strip()} end{k}</p></article>') for k, t in enumerate(own)]
    on, off = main_texts(spark, rows), main_texts(spark, rows, least_pages=0)
    for k, t in enumerate(own):
        lines = [f"T{k}", t, f"{t[:40].strip()} end{k}"]
        assert off[k].split("\n") == [*lines[:2], said(k), lines[2]]
        assert on[k].split("\n") == (lines if k < 4 else [*lines[:2], said(k), lines[2]])


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "</q>" * 100_000, "<i><div><b>" * 50_000 + "</i>" * 50_000, '<a x="' * 100_000, "<a " + "= " * 300_000, "<" * 1_000_000, '<div class="ad">' * 50_000 + "x", '<p class="' + "a" * 1_000_000 + '">x'])
def test_long_pages_take_linear_time(page):
    began = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - began < 5


def main_texts(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_suffix_arrays_decide_in_articles_too(spark):
    rnd = random.Random(8)
    prose = lambda n=60: " ".join(f"w{rnd.randrange(99_999)}" for _ in range(n))
    plea, own, posted = "please join our list " + prose(6), [prose() for _ in range(12)], prose()
    page = lambda *texts: "<nav>a b</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    rows = [(k, "http://h/", page(t, plea)) for k, t in enumerate(own)]
    rows += [(20 + k, "http://h/", page(posted, f"end {k}")) for k in range(11)]  # posted again and again: stays
    rows += [(40, "http://other/", page(own[0], plea)), (41, "http://h/", page(own[0], plea))]
    got = main_texts(spark, rows)
    assert {k: got[k] for k in range(12)} == dict(enumerate(own))
    assert all(got[20 + k] == f"{posted}\nend {k}" for k in range(11)) and got[40] == f"{own[0]}\n{plea}" and got[41] == own[0]
    assert main_texts(spark, rows, broadcast_rows=0) == main_texts(spark, rows, broadcast_rows=25) == got
    off = main_texts(spark, rows, least_pages=0)
    assert all(off[k] == f"{t}\n{plea}" for k, t in enumerate(own))


def test_pages_match_brute_force(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    rows = [(k, f"http://h{k % 3}/", f"<p>{' '.join(rnd.choice(words) for _ in range(rnd.randint(0, 50)))}</p>") for k in range(45)]
    rows += [(100 + k, "http://h0/", rows[0][2]) for k in range(5)]
    got = main_texts(spark, rows, tokens=2)
    for host in range(3):
        own = {k: h[3:-4].split() for k, u, h in rows if u == f"http://h{host}/"}
        seen = Counter(w for t in {tuple(t) for t in own.values() if t} for w in {t[i : i + 2] for i in range(len(t) - 1)})
        need = max(3, -(-len({tuple(t) for t in own.values()}) // 4))
        for k, t in own.items():
            gone = {i + d for i in range(len(t) - 1) if seen[tuple(t[i : i + 2])] >= need for d in (0, 1)}
            assert got[k] == " ".join(w for i, w in enumerate(t) if i not in gone)


def test_host_boilerplate_is_removed(spark):
    boiler = "all rights are reserved by the owners of this fine site and its partners"
    own = ["the quick brown fox jumps over one lazy dog near the river bank today", "a different story of seven small birds that sang until the evening rain came", "third page about stones and how they roll down from the tall mountain side"]
    rows = [(k, f"http://h.example/{k}", f"<div><p>{t}</p><p>{boiler}</p></div>") for k, t in enumerate(own)]
    rows += [(10, "http://other.example/", f"<p>{boiler}</p>"), (11, None, None), (12, "", ""), (13, "http://h.example/0", rows[0][2]), (14, "http://[broken", PAGE), (15, "http://h.example/x", PAGE), (None, "u", "<p>x y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("d1", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(df).collect()}
    assert {k: got[k][0] for k in range(3)} == dict(enumerate(own))
    assert got[10][0] == boiler and got[13][0] == own[0] and got[11] == ("", 0) and got[12] == ("", 0)
    assert got[14] == got[15] and got[14][0].startswith("Head & line\n") and got[14][1] == len(got[14][0])
    assert extract_main_text(df.limit(0)).count() == 0


def test_boilerplate_is_on_many_distinct_pages(spark):
    rnd = random.Random(4)
    prose = lambda n=30: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    run, article, footer = prose(10), prose(), prose(12)
    texts = [prose() for _ in range(16)]
    texts[0] = f"{run} {texts[0]} {run}"  # repeats within one page
    texts[1], texts[2] = f"{texts[1]} {article}", f"{article} {texts[2]}"  # on two pages
    for k in range(3, 6):
        texts[k] += f" {run[:-1]}x {article}"  # the article is on five of 24 pages: fewer than a quarter
    rows = [(k, "http://h.example/", f"<p>{t}</p><p>{footer}</p>") for k, t in enumerate(texts)]
    rows += [(k, "http://h.example/", f"<p>{prose()}</p>") for k in range(16, 24)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(16)} == dict(enumerate(texts))


# --- chat


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B<|im_end|>"), (1, 2, "user", None),
        (2, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, None, "z"), (4, 0, None, "z"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("side", F.lit(2))
    pairs = preference_pairs(df, pair=F.floor(F.col("conv_id") / 2), chosen=F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    got = {r["pair_id"]: r for r in pairs.select("pair_id", "n_prompt_turns", "prompt", text_of("chosen").alias("c"), mask_of("chosen").alias("cm"), text_of("rejected").alias("r"), mask_of("rejected").alias("rm"), "tied").collect()}
    assert set(got) == {0, 1, 2}
    first = got[0]
    assert first["n_prompt_turns"] == 1 and first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and not first["tied"]
    assert first["c"] == "<|im_start|>assistant\nA<|im_end|>\n" and first["cm"] == "0:22,1:12"
    assert first["r"].startswith("<|im_start|>assistant\nB< |im_end|><|im_end|>\n") and first["rm"] == "0:22,1:23,0:17,0:11"
    assert got[1]["tied"] and got[1]["c"] == got[1]["r"] == "" and got[1]["n_prompt_turns"] == 1
    assert got[2]["n_prompt_turns"] == 0 and got[2]["c"] == "<|im_start|>\nz<|im_end|>\n" and got[2]["r"] == ""
    assert pairs.limit(0).count() == 0 and preference_pairs(df.limit(0), pair=F.col("conv_id"), chosen=F.lit(True)).count() == 0


# --- classifier


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        grade = rnd.choice([0, 1, 2, 2, 2])
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if grade == 0:
            text += rnd.sample(["vile", "nasty", "awful", "hateful"], 2)
        if grade == 1:
            text = [w + "!!" for w in text[:3]] * 10
        rnd.shuffle(text)
        rows.append((i, " ".join(text), grade))
    return rows


def test_classifier_on_held_out_texts():
    fit_rows, test_rows = corpus(900, 1), corpus(300, 2)
    model = fit(features([t.encode() for _, t, _ in fit_rows]), np.array([g for *_, g in fit_rows]), 3)
    top = model.tails(features([t.encode() for _, t, _ in test_rows]))
    truth = np.array([g for *_, g in test_rows])
    assert (np.diff(model.thresholds) >= 0).all() and (top[:, 0] >= top[:, 1]).all()
    assert ((top[:, 1] >= 0.5) == (truth == 2)).mean() > 0.95
    expected = top.sum(axis=1)
    assert expected[truth == 0].mean() < expected[truth == 1].mean() + 0.5 and expected[truth == 2].mean() > 1.7


def test_classifier_edges(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (901, ""), (5, rows[5][1])], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("kept", F.lit("a"))
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 2), (7, None), (8, 9)], "doc_id long, grade int")
    model = train(docs, ratings, sample_rows=250)
    out = classify(docs, model)
    assert out.count() == docs.count() and out.where("p_top is null or p_top < 0 or p_top > 1").count() == 0
    assert classify(docs, model, carry=True).select("row.*").columns == docs.columns
    assert classify(docs.limit(0), model).count() == 0
    assert (train(docs, ratings.limit(0)).weights == 0).all()


def test_classifier_on_held_out_labels():
    """Three quarters of the labels of sf0.1 to fit, the rest to judge: the figures that the README gives."""
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR))").fetchall()
    grade, found = np.array([r[1] for r in rows]), features([r[0].encode() for r in rows])
    cut = len(rows) * 3 // 4
    accepted, truth = fit(found[:cut], grade[:cut], 3).tails(found[cut:])[:, 1] >= 0.5, grade[cut:]
    assert (accepted == (truth == 2)).mean() > 0.97 and accepted[truth == 2].mean() > 0.98
    assert accepted[truth == 1].mean() < 0.15 and accepted[truth == 0].mean() < 0.05


def test_classifier_takes_texts_of_any_length(spark):
    rows = [(i, " ".join(["good"] * 30), 2) for i in range(8)] + [(100 + i, "bad " * 30_000, 0) for i in range(8)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int"))
    assert {r["doc_id"]: r["kept"] for r in classify(docs, model).collect()} == {i: g == 2 for i, _, g in rows}


# --- mixing against brute force


def test_places_match_brute_force(spark):
    """Slot by slot over all sources with blocks left: the earliest deadline among released blocks, by exact fractions."""
    from fractions import Fraction

    rnd = random.Random(3)
    for trial in range(4):
        sources = {f"s{k}": rnd.randint(0, 25) for k in range(5)} | {"last": 3}
        weights = {s: rnd.choice([0.1, 1 / 3, 2.0, 7.0, 2**0.5]) for s in sources}
        rows = [(1000 * k + i, s) for k, (s, n) in enumerate(sources.items()) for i in range(n)]
        got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
        left, slot, expected = {s: n for s, n in sources.items() if n}, 0, {}
        taken = dict.fromkeys(left, 0)
        while left:
            total, start, place = sum(Fraction(weights[s]) for s in left), slot, dict.fromkeys(left, 0)
            while True:
                now = slot - start
                windows = []
                for s, j in place.items():
                    rate = Fraction(weights[s]) / total
                    release, deadline, after = (j / rate).__floor__(), ((j + 1) / rate).__ceil__(), ((j + 2) / rate).__ceil__()
                    if release <= now:
                        windows.append((deadline, after - deadline, "+" + s, s))
                s = min(windows)[3]
                if place[s] == left[s]:
                    break
                expected[slot] = (s, taken[s] + place[s])
                place[s] += 1
                slot += 1
            for s, n in place.items():
                taken[s] += n
                left[s] -= n
            left = {s: n for s, n in left.items() if n}
        assert {r["position"]: (r["source"], r["block"]) for r in got} == expected, trial


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from plumbline.llm.classifier import grades
    from plumbline.llm.decontaminate import decontaminate
    from plumbline.llm.near import near_duplicates
    from plumbline.llm.registry import read

    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents")
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources"]
    kept = pipeline.quality(spark, docs, d).cache()
    model = train(docs, grades(read(spark, d, "labels")))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in classify(docs, model).where("kept").collect()}
    near = pipeline.near_copies(spark, kept, d).cache()
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates(kept).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(classes.values()))
    cut = pipeline.repeats(spark, near, d).cache()
    assert cut.columns == docs.columns and cut.where("n_chars <> char_length(text)").count() == 0 and cut.count() <= near.count()
    clean = pipeline.contamination(spark, cut, d).cache()
    bad = {r["doc_id"] for r in decontaminate(cut, read(spark, d, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in cut.collect()} - bad
    mixed = pipeline.mixture(spark, clean, d)
    assert mixed.count() == clean.count() == mixed.select("position").distinct().count()


def test_pipeline_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline as pipeline

    rnd = random.Random(9)
    prose = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(120))
    texts = [prose() for _ in range(6)]
    rows = [(i, t, "en", f"s{k}") for k, (i, t) in enumerate(zip([None, None, None, 7, 7, 8], texts, strict=True))]
    rows += [(None, texts[0] + " end", "de", "s9"), (7, texts[4] + " end", "de", "s9"), (7, texts[5] + " end", "de", "s9"), (None, None, None, "a"), (None, None, "a", None), rows[3]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    kept = pipeline.near_copies(spark, docs, "").cache()
    got = Counter((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in kept.collect())
    assert got == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5]), (None, ""), (None, "")])
    assert set(kept.collect()) <= set(docs.collect())
    few = docs.limit(6)
    assert set(pipeline.repeats(spark, few, "").collect()) == set(few.collect())
    mixed = pipeline.mixture(spark, few, "")
    assert {tuple(r)[:5] for r in mixed.collect()} == {tuple(r) for r in few.collect()} and mixed.select("position").distinct().count() == 6


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(10)
    prose = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    passage = prose(20)
    rows = [(k, prose(60), "en", f"s{k % 3}", 1) for k in range(40)] + [(None, prose(60), None, None, None), (5, prose(60), "en", "s0", 1), (90, None, None, None, None), (91, "", "", "", 0)]
    rows += [(92, prose(150_000), "en", "s1", 1), (93, passage, "en", "s1", 1), rows[0], rows[0]]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"documents": (rows, ddl), "labels": ([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, passage), (None, prose(20))], "item_id long, text string")}
    for name, (data, kinds) in tables.items():
        frame = spark.createDataFrame(data, kinds)
        frame.write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
        frame.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = Counter(r["doc_id"] for r in out)
    assert {k for k in ids if k is not None} >= set(range(40)) | {92} and 93 not in ids and ids[0] == 1 and ids[5] == 2 and ids[None] == 1
    assert len({r["position"] for r in out}) == len(out) and next(r for r in out if r["doc_id"] == 92)["text"] == rows[-4][1]
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
