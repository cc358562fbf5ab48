"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op1_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), ls AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n
  FROM (SELECT k, i, array_to_string(w[i:i+4], ' ') AS gram
        FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))
), c AS (
  SELECT k, count(DISTINCT i + o) AS n_rep FROM g, range(5) r(o) WHERE n > 1 GROUP BY k
), tl AS (
  SELECT k, count(*) AS n_text_lines, count(*) FILTER (regexp_matches(l, '^[•‣▶◀◦■□▪▫–*-]')) AS n_bullets, count(*) FILTER (regexp_matches(l, '(\.\.\.|…)$')) AS n_cut
  FROM (SELECT k, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS l FROM d) WHERE l <> '' GROUP BY k
), pr AS (
  SELECT k, a, b, count(*) AS n FROM (SELECT k, w[i] AS a, w[i+1] AS b FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 50)) GROUP BY k, a, b
), tp AS (SELECT k, max(n * (length(a) + length(b) + 1)) AS pair_chars FROM (SELECT *, max(n) OVER (PARTITION BY k) AS most FROM pr) WHERE n = most GROUP BY k
), m AS (
  SELECT doc_id, coalesce(n_text_lines, 0) AS n_text_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_cut, 0) AS n_cut, coalesce(pair_chars, 0) AS pair_chars, length(text) AS n_chars,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_lettered, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN ls USING (k) LEFT JOIN c USING (k) LEFT JOIN tl USING (k) LEFT JOIN tp USING (k)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= n_words AND 100 * n_dup_lines <= 30 * n_lines
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words
         AND 100 * n_bullets <= 90 * n_text_lines AND 100 * n_cut <= 30 * n_text_lines AND 100 * n_lettered >= 45 * n_words AND NOT (n_words > 50 AND 100 * pair_chars > 20 * n_chars) AS kept
FROM b
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op10_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM iw),
g AS (
  SELECT k, n, i, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT k, g.n, i, item FROM g JOIN iw USING (n, gram)),
words AS (SELECT k, count(DISTINCT i + o) AS n_hit FROM (SELECT k, i, unnest(range(0, n)) AS o FROM hit) GROUP BY k),
names AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN names USING (k)
"""

SQL["op2_lm_score"] = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') || [CAST(NULL AS VARCHAR)] AS w,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out
  FROM documents, crc
), tok AS (
  SELECT k, held_out, i, coalesce('w' || w[i], '/') AS x, CASE WHEN i = 1 THEN '/' ELSE 'w' || w[i-1] END AS u, CASE WHEN i = 2 THEN '/' WHEN i > 2 THEN 'w' || w[i-2] END AS t
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)
), uni AS (SELECT x, count(*) AS c FROM tok WHERE NOT held_out GROUP BY x),
bi AS (SELECT u, x, count(*) AS c2 FROM tok WHERE NOT held_out GROUP BY u, x),
tri AS (SELECT t, u, x, count(*) AS c3 FROM tok WHERE NOT held_out AND t IS NOT NULL GROUP BY t, u, x),
nv AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM uni),
s AS (
  SELECT k, coalesce(a.c, 0) AS c, coalesce(b.c, 0) AS cu, coalesce(bi.c2, 0) AS c2, coalesce(h.c2, 0) AS ctu, coalesce(c3, 0) AS c3, (coalesce(a.c, 0) + 1) / CAST(n + v + 1 AS DOUBLE) AS p
  FROM tok LEFT JOIN uni a ON tok.x = a.x LEFT JOIN uni b ON tok.u = b.x LEFT JOIN bi ON tok.u = bi.u AND tok.x = bi.x
  LEFT JOIN bi h ON tok.t = h.u AND tok.u = h.x LEFT JOIN tri ON tok.t = tri.t AND tok.u = tri.u AND tok.x = tri.x, nv
), f AS (SELECT *, greatest(0.4, pow(1.0 + cu, -0.25)) AS f2, greatest(0.4, pow(1.0 + ctu, -0.25)) AS f3 FROM s),
p2 AS (SELECT *, CASE WHEN cu > 0 THEN (1 - f2) * c2 / CAST(cu AS DOUBLE) + f2 * p ELSE p END AS p2 FROM f),
z AS (
  SELECT k, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10(p)) AS base_score,
         sum(log10(CASE WHEN ctu > 0 THEN (1 - f3) * c3 / CAST(ctu AS DOUBLE) + f3 * p2 ELSE p2 END)) AS score
  FROM p2 GROUP BY k
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN z USING (k), nv
"""

_HEAD = "'<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10)"
_BODY = "replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10)"


def _side(name: str, own: str) -> str:
    return f"""{name} AS (
  SELECT p, string_agg({_HEAD} || {_BODY}, '' ORDER BY i) AS said,
         string_agg('0:' || length({_HEAD}) || ',' || CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END || length({_BODY}), ',' ORDER BY i) AS mask
  FROM s JOIN lcp USING (p) WHERE {own} AND i > n GROUP BY p
)"""


SQL["op9_preference_pairs"] = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS p, conv_id % 2 = 0 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t
), pairs AS (SELECT p, count(*) FILTER (side) AS nc, count(*) FILTER (NOT side) AS nr FROM s GROUP BY p),
same AS (
  SELECT a.p, a.i, count(*) OVER (PARTITION BY a.p ORDER BY a.i) AS k FROM s a JOIN s b
    ON a.p = b.p AND a.i = b.i AND a.side AND NOT b.side AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
), lcp AS (SELECT pairs.p, CAST(coalesce(max(i) FILTER (i = k), 0) AS BIGINT) AS n, any_value(nc) AS nc, any_value(nr) AS nr FROM pairs LEFT JOIN same ON pairs.p = same.p GROUP BY pairs.p),
prompt AS (SELECT p, string_agg({_HEAD} || {_BODY}, '' ORDER BY i) AS said FROM s JOIN lcp USING (p) WHERE side AND i <= n GROUP BY p),
{_side("c", "side")}, {_side("r", "NOT side")}
SELECT lcp.p AS pair_id, n AS n_prompt_turns, coalesce(prompt.said, '') AS prompt, coalesce(c.said, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.said, '') AS rejected, coalesce(r.mask, '') AS rejected_mask, nc = n AND nr = n AS tied
FROM lcp LEFT JOIN prompt USING (p) LEFT JOIN c USING (p) LEFT JOIN r USING (p)
"""

_CHUNKS = " || ".join(f"lpad(translate(to_base(CAST('0x' || substr(h, {10 * k + 1}, 10) AS BIGINT), 32), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 8, 'A')" for k in range(4))

SQL["op3_warc_round_trip"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_CHUNKS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

_DECODED = "regexp_replace(replace(replace(replace(replace(line, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g')"

#: For pages of one article of headings and paragraphs, as the page table has them.
SQL["op7_html_main_text"] = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '</?(p|h1)>', chr(30), 'g'), '<[^>]*>', '', 'g'), chr(30)) AS ls FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(ls, lambda line: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda line: line <> '') AS ls FROM b)
SELECT page_id, url, coalesce(array_to_string(ls, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(ls, chr(10)), '')) AS BIGINT) AS n_chars FROM c
"""

SQL["op6_near_duplicates"] = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT k, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT k, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), sets AS (SELECT k, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS c, count(*) AS size FROM sh GROUP BY k),
classes AS (SELECT c, any_value(size) AS size, count(*) AS n_copies, min(doc_id) AS copy_id, min(k) AS k FROM sets JOIN d USING (k) GROUP BY c),
cs AS (SELECT c, size, gram FROM classes JOIN sh USING (k)),
links AS (
  SELECT a.c AS u, b.c AS v FROM cs a JOIN cs b ON a.gram = b.gram AND a.c <> b.c AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
  GROUP BY a.c, b.c HAVING 5 * count(*) >= 4 * (any_value(a.size) + any_value(b.size) - count(*))
), reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, v FROM reach JOIN links ON r = u),
heads AS (SELECT reach.c AS c, min(copy_id) AS class_id FROM reach JOIN classes ON r = classes.c GROUP BY reach.c),
n AS (SELECT u AS c, count(*) AS n_links FROM links GROUP BY u)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN sets USING (k) LEFT JOIN classes USING (c) LEFT JOIN heads USING (c) LEFT JOIN n USING (c)
"""

#: Bytes as hexadecimal digits, two a byte; windows are compared by 128 bits.
SQL["op8_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5_number(h[2*i+1:2*i+400]) AS m FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
marked AS (SELECT k, i, CASE WHEN lag(i) OVER (PARTITION BY k ORDER BY i) >= i - 200 THEN 0 ELSE 1 END AS fresh FROM hit),
spans AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM marked) GROUP BY k, g),
gaps AS (
  SELECT k, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS a, a AS b FROM spans
  UNION ALL SELECT k, max(b), max(len(h)) // 2 FROM spans JOIN d USING (k) GROUP BY k
), kept AS (SELECT k, string_agg(h[2*a+1:2*b], '' ORDER BY a) AS h FROM gaps JOIN d USING (k) GROUP BY k),
f AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN f USING (k) LEFT JOIN kept USING (k)
"""


def _clusters(k: int, rounds: int, size: int) -> str:
    """Lloyd's rounds written out: each assigns all vectors, then takes exact floors of means."""
    near = """SELECT id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT v.id AS id, m.c AS c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY v.id, m.c) GROUP BY id"""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT id, vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT row_number() OVER () AS id, vec_id, embedding, unnest(range(1, {size + 1})) AS i FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, xs) - 1 AS c, unnest(range(1, {size + 1})) AS i, unnest(xs) AS x
  FROM (SELECT sha256('3:' || vec_id) AS h, list(x ORDER BY i) AS xs FROM v GROUP BY id, vec_id ORDER BY h, xs LIMIT {k})
)""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT m.c AS c, m.i AS i, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x
  FROM c{r} m LEFT JOIN (SELECT a.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} a USING (id) GROUP BY a.c, i) t ON m.c = t.c AND m.i = t.i
)""")
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    parts.append(f"marks AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT DISTINCT id, vec_id FROM v) USING (id) JOIN marks USING (c)
"""


SQL["op11_centroid_clusters"] = _clusters(8, 10, 64)

_BLANK = r"[^\x20\x09-\x0D]"

#: The plain dynamic program, turn by turn: (cost, audit, text) of each last role.
SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM named, crc
), kept AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE h > 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM kept
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM ordered
), bridge(f, t, n, said) AS (VALUES ('-', 's', '', ''), ('-', 'u', '', ''), ('-', 'a', 'I', 'user:' || chr(10)), ('s', 'u', '', ''), ('s', 'a', 'I', 'user:' || chr(10)),
  ('u', 'a', '', ''), ('u', 'u', 'I', 'assistant:' || chr(10)), ('a', 'u', '', ''), ('a', 'a', 'I', 'user:' || chr(10))
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '-' AS st, {{'cost': 0, 'audit': '', 'said': ''}} AS best FROM conversations
  UNION ALL
  SELECT conv_id, i, st, min(best) FROM (
    SELECT dp.conv_id, dp.i + 1 AS i, dp.st AS st, {{'cost': best.cost + 2, 'audit': best.audit || 'D', 'said': best.said}} AS best
    FROM dp JOIN marked m ON dp.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = dp.i + 1
    UNION ALL
    SELECT dp.conv_id, dp.i + 1, b.t,
           {{'cost': best.cost + 5 * length(b.n) + CASE WHEN m.role[1] = b.t THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END,
             'audit': best.audit || b.n || CASE WHEN m.role[1] = b.t THEN 'K' ELSE 'R' END,
             'said': best.said || b.said || CASE WHEN m.role[1] = b.t THEN m.role WHEN b.t = 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text || chr(10)}}
    FROM dp JOIN marked m ON dp.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = dp.i + 1 JOIN bridge b ON b.f = dp.st
    WHERE fault NOT IN ('b', 'd') AND (b.t <> 's' OR m.role[1] = 's')
  ) GROUP BY conv_id, i, st
), f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n FROM marked GROUP BY conv_id
), ends AS (
  SELECT dp.conv_id AS conv_id, min({{'cost': best.cost + 5 * length(e.n), 'audit': best.audit || e.n, 'said': best.said || e.said}}) AS best
  FROM dp LEFT JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id
  JOIN (VALUES ('-', '', ''), ('s', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'I', 'assistant:' || chr(10)), ('a', '', '')) e(f, n, said) ON e.f = dp.st
  WHERE dp.i = coalesce(f.n, 0) GROUP BY dp.conv_id
)
SELECT ends.conv_id AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(CASE WHEN best.said = '' THEN '' ELSE best.said[:-2] END) AS repaired_sha256
FROM ends LEFT JOIN f ON ends.conv_id IS NOT DISTINCT FROM f.conv_id
"""

#: Slot by slot: windows of each source's next block by whole numbers (weights are square roots, scaled by 2^52).
SQL["op4_pfair_mixing"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents
), ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS r FROM d),
w AS (SELECT s, CAST(sqrt(count(*)) * 4503599627370496 AS HUGEINT) AS a, (count(*) + 7) // 8 AS n FROM d GROUP BY s),
lists AS (SELECT list(s ORDER BY s) AS names, list(a ORDER BY s) AS rates, list(CAST(n AS HUGEINT) ORDER BY s) AS blocks FROM w),
mix(slot, start, phase, taken, first, pick, block) AS (
  SELECT CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), 0, list_transform(names, lambda x: CAST(0 AS HUGEINT)), list_transform(names, lambda x: CAST(0 AS HUGEINT)), CAST(NULL AS BIGINT), CAST(NULL AS HUGEINT) FROM lists
  UNION ALL
  SELECT CASE WHEN over THEN slot ELSE slot + 1 END, CASE WHEN over THEN slot ELSE start END, CASE WHEN over THEN phase + 1 ELSE phase END,
         CASE WHEN over THEN taken ELSE list_transform(taken, lambda x, i: CASE WHEN i = best.i THEN x + 1 ELSE x END) END, CASE WHEN over THEN taken ELSE first END,
         CASE WHEN over THEN NULL ELSE best.i END, CASE WHEN over THEN NULL ELSE taken[best.i] END
  FROM (SELECT *, taken[best.i] >= blocks[best.i] AS over FROM (
    SELECT *, list_sort(list_filter(list_transform(range(1, len(names) + 1), lambda i: CASE WHEN first[i] < blocks[i] AND (taken[i] - first[i]) * total // rates[i] <= slot - start
      THEN {'d': ((taken[i] - first[i] + 1) * total + rates[i] - 1) // rates[i], 'g': ((taken[i] - first[i] + 2) * total + rates[i] - 1) // rates[i] - ((taken[i] - first[i] + 1) * total + rates[i] - 1) // rates[i], 's': names[i], 'i': i} END), lambda x: x IS NOT NULL))[1] AS best
    FROM (SELECT mix.*, names, rates, blocks, CAST(list_sum(list_transform(rates, lambda a, i: CASE WHEN first[i] < blocks[i] THEN a ELSE 0 END)) AS HUGEINT) AS total FROM mix, lists
          WHERE len(list_filter(range(1, len(names) + 1), lambda i: taken[i] < blocks[i])) > 0)))
), placed AS (SELECT names[pick] AS s, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) - 1 AS slot, phase FROM mix, lists WHERE pick IS NOT NULL)
SELECT doc_id, source, slot * 8 + r % 8 AS position, slot, r // 8 AS block, phase FROM ranked JOIN placed ON ranked.s = placed.s AND r // 8 = block
"""
