"""Main text of web pages: what markup bounds, and what each host's suffix array finds repeated.

A page becomes blocks of text. Markup bounds what can be main text: blocks inside an article or main
element where a page has one, and no menus, headers, footers, sidebars or forms, unless such an element holds
the article or most of the text. A class name, id or role (``cookie-notice``) only nominates an element: it
goes if its make-up is that of furniture (links, controls, no sentence of its own); one of prose stays, and
its words go if the host repeats them. The words of *all* blocks of a page, in order, are its token stream.
Substrings of a host's streams that lie on many distinct pages are boilerplate and are cut from the main
text; unique runs, runs that repeat within a page, and articles that were posted again stay.

The suffix array of a host is built by the tasks that hold its pages: each sorts the suffixes of its
pages' streams, reads the repeated substrings off adjacent prefixes, and counts the pages of each; the
counts are added up over tasks. A host of any size is spread over all tasks. Only stretches of a stream
that can be boilerplate are sorted: those whose least gram hashes lie on enough pages of the host. Pages are
parsed once; their blocks are a table in the shared folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as T
from plumbline.llm.decontaminate import _sliding_min
from plumbline.llm.suffixes import suffix_order
from plumbline.llm.warc import shared_folder

#: Words of a host's repeated substring, and of the grams that select stretches of a stream.
TOKENS, GRAM = 8, 3
#: Distinct pages of a host that boilerplate is on: at least so many, and this share of the host's,
#: outside and inside an article or main element.
PAGES, SHARE = 3, 0.25
MAIN_PAGES, MAIN_SHARE = 5, 0.5
#: Rows of a table up to which it is broadcast (8 or 17 bytes a row); larger ones are joined.
BROADCAST_ROWS = 400_000
#: Parts of a hot host's pages where boilerplate is joined.
SALTS = 32
# Element names of HTML by role.
DROPPED = frozenset("nav aside footer form script style noscript template iframe object select button svg canvas dialog menu head title".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
MAIN = frozenset(["article", "main"])
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input button select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Last parts of class names, ids and roles that mark what is not main text (``cookie-notice``, ``ad``).
UNWANTED = re.compile(r"(?<![^\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|complementary|contentinfo)(?=\s|$)", re.I)
#: Marks of reader comments: what they hold is prose of others, so it goes unless it is the page's own main text.
COMMENTS = re.compile(r"(?<![^\s_-])(?:comments?|replies|respond)(?=\s|$)", re.I)
#: A nominated element without a block of so many words (so few, with a heading of its own) is furniture, as is one
#: with controls or with this share of its words in links.
PROSE, HEADED, LINKED = 15, 6, 0.3
#: A line of rights, on pages without an article element.
RIGHTS = re.compile(r"(?:\u00a9|\(c\)|copyright\b|all rights reserved)", re.I)
#: Tags without attribute values; others are scanned step by step.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"'=]*)>")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STEP = re.compile(r">|=\s*([\"'])")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$|/)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: The host of a url; null and broken urls have the empty host.
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"


def tags(page: str):
    """(start, end, whether it closes, name or None, attributes) of each tag or comment, in one forward pass.

    An opening bracket without an end is text. What was not found once is not searched again, so the
    time is linear in the page.
    """
    at, n, quotes, brackets = 0, len(page), {'"': True, "'": True}, True
    while brackets and (start := page.find("<", at)) >= 0:
        if plain := _PLAIN.match(page, start):
            at = plain.end()
            yield start, at, plain[1] == "/", plain[2].lower(), plain[3]
            continue
        lead = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, False, None, ""
        elif lead in ("!", "?") and lead:
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, False, None, ""
        elif name := _NAME.match(page, start + 1 + (lead == "/")):
            place = name.end()
            while True:
                step = _STEP.search(page, place)
                if step is None:
                    brackets = False
                    break
                mark, place = step.group(1), step.end()
                if mark is None:
                    break
                if quotes[mark]:
                    close = page.find(mark, place)
                    if close < 0:
                        quotes[mark] = False
                    else:
                        place = close + 1
            if brackets:
                at = place
                yield start, at, lead == "/", name.group().lower(), page[name.end() : at - 1]
        else:
            at = start + 1


@dataclass
class _Element:
    """An open question: an element that its name drops or a mark nominates, and what it holds (words outside links)."""

    kind: str  # "" (the page), "name", "hidden", "nominated" or "comments"
    above: int
    words: int = 0
    linked: int = 0
    own: int = 0
    longest: int = 0
    controls: int = 0
    heading: bool = False
    title: bool = False
    main: bool = False

    def goes(self, every: int, own: int) -> bool:
        if self.kind == "name":  # a form around the article, an aside that holds most of the text: opened
            return not self.main and (2 * self.words <= every or self.longest < PROSE)
        if self.kind in ("nominated", "comments") and (self.title or 2 * self.own > own):
            return False
        if self.kind == "nominated":
            furniture = self.controls or self.linked >= LINKED * (self.words + self.linked)
            return bool(furniture) or self.longest < (HEADED if self.heading else PROSE)
        return self.kind in ("hidden", "comments")


def blocks(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, whether it can be main text, whether it is inside an article or main element, whether it was nominated) of each block, in order."""
    found: list[tuple[str, int, bool, str, int, int]] = []  # text, element, main, heading, words, words in links
    stack: list[tuple[str, int, bool, str]] = []  # name, then what holds inside it: element, main, heading
    elements = [_Element("", 0)]
    inline, outer = [{}], {}  # open inline elements of each block level, open block elements
    held: list[str] = []
    links: list[str] = []
    state = (0, False, "")

    def close() -> None:
        if held:
            words = unescape("".join(held)).split()
            if words:
                linked = min(len(" ".join(links).split()), len(words)) if links else 0
                found.append((" ".join(words), state[0], state[1], state[2], len(words) - linked, linked))
            held.clear()
            links.clear()

    def pop() -> str:
        name = stack.pop()[0]
        if name in BLOCK:
            inline.pop()
            outer[name] -= 1
        else:
            inline[-1][name] -= 1
        return name

    def say(piece: str) -> None:
        nonlocal state
        now = stack[-1][1:] if stack else (0, False, "")
        if held and now != state:
            close()
        state = now
        held.append(piece)
        if inline[-1].get("a"):
            links.append(piece)

    at, raw_end = 0, 0
    for start, end, closing, name, attributes in tags(page):
        if start < raw_end:
            continue
        if start > at:
            say(page[at:start])
        at = end
        if name is None:
            continue
        if name == "br":
            if held:
                held.append(" ")
            continue
        block = name in BLOCK
        if block:
            close()
        if closing:
            if (outer if block else inline[-1]).get(name):
                while pop() != name:
                    pass
            continue
        element, main, heading = stack[-1][1:] if stack else (0, False, "")
        if name in CONTROLS:
            elements[element].controls += 1
        if name in VOID or attributes.rstrip().endswith("/") and not block:
            continue
        if name in RAW:
            stop = _RAW_END[name].search(page, end)
            at = raw_end = stop.end() if stop else len(page)
            continue
        if name == "p":  # a paragraph ends where a block begins
            while stack and stack[-1][0] == "p":
                pop()
        kinds = []
        if name in DROPPED or name == "header" and not main:
            kinds.append("name")
        if attributes and name not in ("html", "body"):
            if _HIDDEN.search(attributes):
                kinds.append("hidden")
            marks = [a or b or c for a, b, c in _MARKS.findall(attributes)]
            if any(COMMENTS.search(m) for m in marks):
                kinds.append("comments")
            elif any(UNWANTED.search(m) for m in marks):
                kinds.append("nominated")
        for kind in kinds:
            elements.append(_Element(kind, element))
            element = len(elements) - 1
        if name in MAIN:
            main = elements[element].main = True
        if name in HEADINGS:
            heading = name
        stack.append((name, element, main, heading))
        if block:
            inline.append({})
            outer[name] = outer.get(name, 0) + 1
        else:
            inline[-1][name] = inline[-1].get(name, 0) + 1
    if at < len(page):
        say(page[at:])
    close()
    return _kept(found, elements)


def _kept(found: list[tuple], elements: list[_Element]) -> list[tuple[str, bool, bool, bool]]:
    """The verdicts: first on elements that names drop or hide, which tells where the main text is, then on nominated ones."""
    for _, k, _, heading, words, linked in found:
        e = elements[k]
        e.words, e.linked, e.heading, e.title = e.words + words, e.linked + linked, e.heading or bool(heading), e.title or heading == "h1"
        e.longest = e.longest if heading else max(e.longest, words + linked)
    for e in reversed(elements[1:]):  # an element comes after the one around it
        up = elements[e.above]
        up.words, up.linked, up.controls, up.longest = up.words + e.words, up.linked + e.linked, up.controls + e.controls, max(up.longest, e.longest)
        up.heading, up.title, up.main = up.heading or e.heading, up.title or e.title, up.main or e.main
    gone = [False] * len(elements)
    for k, e in enumerate(elements):
        if k:
            gone[k] = gone[e.above] or e.kind in ("name", "hidden") and e.goes(elements[0].words, 0)
    bounded = any(main and not gone[k] for _, k, main, *_ in found)
    inside = [not gone[k] and main >= bounded for _, k, main, *_ in found]
    for (_, k, _, _, words, linked), own in zip(found, inside, strict=True):
        elements[k].own += (words + linked) * own
    for e in reversed(elements[1:]):
        elements[e.above].own += e.own
    suspect = [False] * len(elements)
    for k, e in enumerate(elements):
        if k:
            gone[k] = gone[e.above] or gone[k] or e.kind in ("nominated", "comments") and e.goes(elements[0].words, elements[0].own)
            suspect[k] = suspect[e.above] or e.kind == "nominated"
    rights = lambda text, words: not bounded and words < PROSE and RIGHTS.match(text)
    return [(text, own and not gone[k] and not rights(text, words + linked), main, suspect[k]) for (text, k, main, _, words, linked), own in zip(found, inside, strict=True)]


def _windows(hashes: np.ndarray, counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64 bits, 64 more bits, number of each stream) of the windows of ``tokens`` words."""
    one, runs = T.ngrams(hashes, counts, tokens)
    return one.view(np.int64), T.ngrams(T.mix(hashes + np.uint64(1)), counts, tokens)[0].view(np.int64), runs


def repeated_on_pages(pieces: list[np.ndarray], page_of: list[int], tokens: int):
    """(a position of each distinct window of ``tokens`` symbols, distinct pages that it is on), by suffix sorting.

    ``pieces`` are stretches of token streams; windows do not cross their ends.
    """
    sizes = np.array([len(p) for p in pieces])
    flat = np.concatenate(pieces)
    owner = np.repeat(np.array(page_of), sizes)
    room = np.arange(len(flat)) + tokens <= np.repeat(np.cumsum(sizes), sizes)
    symbols = np.unique(flat, return_inverse=True)[1]
    order = suffix_order(symbols, tokens)
    order = order[room[order]]
    if not len(order):
        return flat, order, order
    same = np.ones(len(order) - 1, bool)
    for k in range(tokens):
        same &= symbols[order[:-1] + k] == symbols[order[1:] + k]
    group = np.append(0, np.cumsum(~same))
    first = np.flatnonzero(np.append(True, ~same))
    pairs = np.unique(group * (int(owner.max()) + 1) + owner[order])
    return flat, order[first], np.bincount(pairs // (int(owner.max()) + 1), minlength=len(first))


def extract_main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tokens: int = TOKENS, least_pages: int = PAGES, share: float = SHARE,
    main_pages: int = MAIN_PAGES, main_share: float = MAIN_SHARE, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``; the text is empty if there is none.

    Null and empty pages have no text; null and broken urls share the empty host; equal pages of a host
    count as one page; an empty table gives an empty result; other columns are ignored. Lines are blocks.
    A run of ``tokens`` words is boilerplate if it is on at least ``least_pages`` distinct pages of its
    host, and on at least ``share`` of them; inside an article or main element it takes ``main_pages`` and
    ``main_share`` (not in elements that a class name, id or role nominated), and a page that would lose more
    than half of its words there loses none (an article that was posted again). ``least_pages`` 0 leaves the
    suffix arrays out. The table of blocks stays in the shared folder, as the result reads it.
    """
    spark = pages.sparkSession
    T.prepare(spark)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    url = F.col(url_col).cast("string")
    raw = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))).alias("host"), F.md5(html_col).alias("mark"), F.col(html_col).alias("html"))
    gram = max(1, min(GRAM, tokens - 1))

    def parse(batches):
        """Blocks of each page; flags are 1 (can be main text), 2 (inside an article) and 4 (nominated), a byte a block."""
        for batch in batches:
            column = batch.column(4)
            for start in range(0, batch.num_rows, 50):
                own = [blocks(x) if x else [] for x in column.slice(start, 50).to_pylist()]
                flags = [bytes(keep + 2 * main + 4 * suspect for _, keep, main, suspect in page) for page in own]
                part = batch.slice(start, 50)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([[t for t, *_ in page] for page in own], pa.list_(pa.string())), pa.array(flags, pa.binary())], names=["id", "url", "host", "mark", "texts", "flags"])

    folder = shared_folder(spark, "pages")
    raw.mapInArrow(parse, f"id {kind}, url string, host long, mark string, texts array<string>, flags binary").write.parquet(folder, compression="zstd")
    source = spark.read.schema(f"id {kind}, url string, host long, mark string, texts array<string>, flags binary").parquet(folder)

    def parsed(column, hosts, wanted=None, flags=None):
        """(pages' blocks, salted word hashes, words of each block, words of each page) by chunks of a batch.

        Pages of other hosts than ``wanted`` (those with boilerplate) get no words.
        """
        own_hosts = np.ones(len(hosts), bool) if wanted is None else np.isin(hosts.to_numpy(), wanted)
        texts = column.to_pylist()
        marks = [b"\0" * len(t) for t in texts] if flags is None else flags.to_pylist()
        salts = T.mix(hosts.to_numpy().view(np.uint64))
        size = start = 0
        for k, page in enumerate(texts):
            size += sum(map(len, page))
            if size > T.CHUNK_BYTES or k == len(texts) - 1:
                own = [[(t, bool(f & 1), bool(f & 2), bool(f & 4)) for t, f in zip(*both, strict=True)] for both in zip(texts[start : k + 1], marks[start : k + 1], strict=True)]
                words, counts = T.words([t.encode() if ok else b"" for page, ok in zip(own, own_hosts[start : k + 1], strict=True) for t, *_ in page], ~T.SPACES, fold=False)
                ends = np.cumsum(np.append(0, counts))
                places = np.cumsum([0, *map(len, own)])
                totals = ends[places[1:]] - ends[places[:-1]]
                yield slice(start, k + 1), own, T.mix(words ^ np.repeat(salts[start : k + 1], totals)), counts, totals
                size, start = 0, k + 1

    def least(words, totals):
        """(least gram hash of each window, windows of each page)."""
        grams, runs = T.ngrams(words, totals, gram)
        width, room = tokens - gram + 1, np.maximum(totals - tokens + 1, 0)
        if len(grams) < width:
            return np.empty(0, np.uint64), room
        every = _sliding_min(grams, width)
        starts = np.cumsum(runs) - runs
        return every[np.repeat(starts, room) + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))], room

    def keys(found, hosts, room):
        """The host and the least gram of each window in one integer, 32 bits each: it only selects stretches."""
        return (np.repeat(hosts.view(np.uint64) << np.uint64(32), room) | (found >> np.uint64(32))).view(np.int64)

    def emit_keys(batches):
        for batch in batches:
            for part, _, words, _, totals in parsed(batch.column(0), batch.column(1)):
                found, room = least(words, totals)
                marked = keys(found, batch.column(1).to_numpy()[part], room)
                ends = np.cumsum(room)
                own = [np.unique(marked[b - n : b]) for b, n in zip(ends.tolist(), room.tolist(), strict=True) if n]
                if own:
                    yield pa.RecordBatch.from_pydict({"key": np.concatenate(own)})

    def finish(batches, table=None):
        """Main texts; ``table``: the windows of boilerplate, as from ``_sorted``."""
        for batch in batches:
            hosts, texts = batch.column(3), []
            for part, own, words, counts, totals in parsed(batch.column(2), hosts, table and table[3], batch.column(4)):
                hit, strong = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
                one, two, runs = _windows(words, totals, tokens)
                firsts = np.repeat(np.cumsum(totals) - totals, runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
                if table is not None:
                    own_tables = [table] if len(table[0]) else []
                else:  # each row brings its host's boilerplate
                    got = [x for x in batch.column(5)[part].to_pylist() if x]
                    own_tables = [_sorted([(w["w1"], w["w2"], w["strong"], 0) for x in got for w in x])] if got else []
                for w1, w2, main, _ in own_tables:
                    at = np.minimum(np.searchsorted(w1, one), len(w1) - 1)
                    ok = (w1[at] == one) & (w2[at] == two)
                    for mark, which in ((hit, ok), (strong, ok & main[at])):
                        np.add.at(mark, firsts[which], 1)
                        np.add.at(mark, firsts[which] + tokens, -1)
                covered, surely = np.cumsum(hit)[:-1] > 0, np.cumsum(strong)[:-1] > 0
                at_block = at_word = 0
                for page in own:
                    sizes = counts[at_block : at_block + len(page)].tolist()
                    inside = any(k and m for _, k, m, _ in page)
                    lines, lost, total = [], 0, 0
                    for (text, kept, _, nominated), n in zip(page, sizes, strict=True):
                        if kept:
                            off = (surely if inside and not nominated else covered)[at_word : at_word + n]
                            lines.append((text, off, nominated))
                            lost, total = lost + int(off.sum()) * (not nominated), total + n * (not nominated)
                        at_word += n
                    again = inside and 2 * lost > total  # an article that was posted again
                    left = [" ".join(w for w, x in zip(text.split(" "), off, strict=True) if not x) if off.any() and (nominated or not again) else text for text, off, nominated in lines]
                    texts.append("\n".join(x for x in left if x))
                    at_block += len(page)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    schema = f"id {kind}, url string, text string, n_chars long"
    nothing, whole = _sorted([]), source.select("id", "url", "texts", "host", "flags")
    if not least_pages:
        return whole.mapInArrow(lambda batches: finish(batches, nothing), schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)

    streams = source.where(F.size("texts") > 0).select("texts", "host", "mark")
    distinct = streams.select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("n"))
    need = lambda least, part: F.greatest(F.lit(least), F.ceil(F.col("n") * F.lit(part)))
    needs = distinct.where(F.col("n") >= least_pages).select("host", need(least_pages, share).alias("need"), need(main_pages, main_share).alias("need_main"))
    # Each window's least gram is on at least as many pages as the window. Keys hold the low half of a host.
    low = needs.groupBy(F.shiftleft("host", 32).alias("low")).agg(F.min("need").alias("need"))
    often = streams.select("texts", "host").mapInArrow(emit_keys, "key long").groupBy("key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    often = often.join(low, F.shiftleft(F.shiftright("key", 32), 32) == F.col("low")).where(F.col("pages") >= F.col("need")).select("key")
    taken = often.limit(broadcast_rows + 1).toArrow().column(0).to_numpy()
    # More keys than may be broadcast select nothing: whole streams are sorted then.
    chosen = np.sort(taken) if len(taken) <= broadcast_rows else None
    if chosen is not None and not len(chosen):
        return whole.mapInArrow(lambda batches: finish(batches, nothing), schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)

    hosts_chosen = None if chosen is None else np.unique(chosen >> 32)

    def emit_stretches(batches):
        for batch in batches:
            if hosts_chosen is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(1).to_numpy() << 32 >> 32, hosts_chosen)))
            hosts = batch.column(1).to_numpy()
            for part, own, words, _, totals in parsed(batch.column(0), batch.column(1)):
                found, room = least(words, totals)
                marked = keys(found, hosts[part], room)
                good = np.ones(len(marked), bool) if chosen is None else chosen[np.minimum(np.searchsorted(chosen, marked), len(chosen) - 1)] == marked
                out: dict[str, list] = {"lengths": [], "tokens": []}
                at_word = at_window = 0
                for n, windows in zip(totals.tolist(), room.tolist(), strict=True):
                    hits = np.flatnonzero(good[at_window : at_window + windows])
                    breaks = np.flatnonzero(np.diff(hits) > 1)
                    firsts, lasts = (hits[np.append(0, breaks + 1)], hits[np.append(breaks, len(hits) - 1)]) if len(hits) else (hits, hits)
                    out["lengths"].append((lasts - firsts + tokens).tolist())
                    out["tokens"].append(b"".join(words[at_word + a : at_word + b + tokens].tobytes() for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)))
                    at_word, at_window = at_word + n, at_window + windows
                keep = pa.array([bool(x) for x in out["lengths"]])
                yield pa.RecordBatch.from_pydict({"host": batch.column(1)[part], "mark": batch.column(2)[part], "lengths": pa.array(out["lengths"], pa.list_(pa.int32())), "tokens": pa.array(out["tokens"], pa.binary())}).filter(keep)

    def sort_suffixes(batches):
        for batch in batches:
            pieces, page_of, size, rows = [], [], 0, batch.num_rows
            hosts = batch.column(0).to_numpy()
            for k, (lengths, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at, words = 0, np.frombuffer(data, np.uint64)
                for n in lengths:
                    pieces.append(words[at : at + n])
                    page_of.append(k)
                    at += n
                size += at
                if pieces and (size > 1 << 20 or k == rows - 1):
                    flat, firsts, counted = repeated_on_pages(pieces, page_of, tokens)
                    if len(firsts):
                        owner = np.repeat(np.array(page_of), [len(p) for p in pieces])[firsts]
                        own = flat[firsts[:, None] + np.arange(tokens)].ravel()
                        one, two, _ = _windows(own, np.full(len(firsts), tokens), tokens)
                        yield pa.RecordBatch.from_pydict({"host": hosts[owner], "w1": one, "w2": two, "pages": counted.astype(np.int64)})
                    pieces, page_of, size = [], [], 0

    stretches = streams.mapInArrow(emit_stretches, "host long, mark string, lengths array<int>, tokens binary").dropDuplicates(["host", "mark"]).select("host", "lengths", "tokens")
    counted = stretches.mapInArrow(sort_suffixes, "host long, w1 long, w2 long, pages long").groupBy("host", "w1", "w2").agg(F.sum("pages").alias("pages"))
    boiler = counted.join(needs, "host").where("pages >= need").select("host", "w1", "w2", (F.col("pages") >= F.col("need_main")).alias("strong"))
    rows = boiler.select("w1", "w2", "strong", "host").limit(broadcast_rows + 1).toArrow()
    if rows.num_rows <= broadcast_rows:
        table = _sorted(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)))
        out = whole.mapInArrow(lambda batches: finish(batches, table), schema)
    else:
        # A host's boilerplate is at most 1 / share times as long as its mean page, so it fits in a row.
        by_host = boiler.groupBy("host").agg(F.collect_list(F.struct("w1", "w2", "strong")).alias("boiler")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = source.withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.lit(SALTS)).cast("int"))
        out = salted.join(by_host, ["host", "salt"], "left").select("id", "url", "texts", "host", "flags", "boiler").mapInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _sorted(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (two longs, whether they are boilerplate in main text, host) as arrays in order; the hosts once each."""
    rows = sorted(rows)
    one, two, strong, hosts = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return np.array(one, np.int64), np.array(two, np.int64), np.array(strong, bool), np.unique(np.array(hosts, np.int64))
