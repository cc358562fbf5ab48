"""DuckDB SQL of model queries: closed forms, step-by-step recursions, and all pairs of a few hundred rows."""

from __future__ import annotations

import math

from plumbline.plans import oracles as O
from plumbline.plans.oracles import BASKETS, DAILY, FORWARD, GAPS, INTERACTIONS, LEDGER, MATCHES, MONTHLY, POLICIES, RANKING, SCORED, SQL, add

# --- ratings


def _elo(season: int | None) -> list[str]:
    """CTEs that update the list of ratings match by match."""
    pulled = f"CASE WHEN m.idx // {season} <> (m.idx - 1) // {season} THEN list_transform(r, lambda x: x + CAST(0.25 AS DOUBLE) * (1500 - x)) ELSE r END" if season else "r"
    return [
        MATCHES, "teams AS (SELECT team, row_number() OVER (ORDER BY team) AS t FROM (SELECT home AS team FROM matches UNION SELECT away FROM matches))",
        "m AS (SELECT idx, hg, ag, h.t AS h, a.t AS a FROM matches JOIN teams h ON h.team = home JOIN teams a ON a.team = away)",
        f"""fold(idx, r, home_rating, away_rating, expected) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(range((SELECT count(*) FROM teams)), lambda x: CAST(1500 AS DOUBLE)), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT idx, list_transform(q, lambda x, i: x + CASE WHEN i = h THEN step ELSE 0 END - CASE WHEN i = a THEN step ELSE 0 END), q[h], q[a], e
  FROM (SELECT *, 20 * (1 + CAST(0.35 AS DOUBLE) * ln(1 + abs(hg - ag))) * (CASE WHEN hg > ag THEN 1.0 WHEN hg = ag THEN 0.5 ELSE 0.0 END - e) AS step
        FROM (SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), -(q[h] + 65 - q[a]) / 400)) AS e FROM (SELECT m.*, {pulled} AS q FROM fold JOIN m ON m.idx = fold.idx + 1))))""",
    ]


_THREE = ["""three AS (
  SELECT i.*, 0.75 * s AS r0, CAST(0.25 AS DOUBLE) AS r1, 0.75 * (1 - s) AS r2
  FROM (SELECT idx, greatest(CAST(0.01 AS DOUBLE), least(CAST(0.99 AS DOUBLE), (expected - CAST(0.125 AS DOUBLE)) / 0.75)) AS s FROM fold WHERE idx >= 0) JOIN implied i USING (idx))"""]
_ELO = _elo(None)
add("elo_ratings", "idx# home_rating* away_rating* expected*", _ELO, "SELECT * FROM fold WHERE idx >= 0")
add("elo_seasons", "idx# home_rating* away_rating* expected*", _elo(500), "SELECT * FROM fold WHERE idx >= 0")
add("elo_scores", "brier* log_loss* accuracy* n#", [*_ELO, *_THREE, "rated AS (SELECT outcome, r0 AS p0, r1 AS p1, r2 AS p2 FROM three)"], O._SCORES + "rated")
add("betting_edge", "bets# profit* roi*", [*_ELO, *_THREE, "edges AS (SELECT *, r0 - p0 AS e0, r1 - p1 AS e1, r2 - p2 AS e2 FROM three)",
    "picks AS (SELECT *, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS pick FROM edges WHERE greatest(e0, e1, e2) > 0)",
    "pnl AS (SELECT CASE WHEN pick = outcome THEN CASE pick WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END - 1 ELSE CAST(-1 AS DOUBLE) END AS p FROM picks)"], "SELECT count(*) AS bets, sum(p) AS profit, avg(p) AS roi FROM pnl")
for _name in ("elo_ratings", "elo_seasons", "elo_scores", "betting_edge"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)

# --- tails of distributions, by Simpson's rule


def _simpson(density: str, upto: str, cells: int = 2000) -> str:
    """The integral from 0 to ``upto`` of a density, an expression over x."""
    return f"({upto}) / {3 * cells} * list_sum(list_transform(range({cells} + 1), lambda i: (CASE WHEN i = 0 OR i = {cells} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('@', f'(({upto}) * i / CAST({cells} AS DOUBLE))')}))"


def _phi(z: str) -> str:
    return f"(0.5 + {_simpson('exp(-@ * @ / 2)', z)} / sqrt(2 * pi()))"


def _quantile(p: str) -> str:
    """The normal quantile of p > 0.5: Newton's steps from 0 come from below."""
    return f"list_reduce([CAST(0 AS DOUBLE)] || list_transform(range(40), lambda k: CAST(0 AS DOUBLE)), lambda x, k: x - ({_phi('x')} - ({p})) / (exp(-x * x / 2) / sqrt(2 * pi())))"


_EULER = "CAST(0.5772156649015329 AS DOUBLE)"
add("deflated_sharpe", "rule observed_ann* benchmark_ann* probability_real* n_trials# n_observations# survives min_track_record*", [
    DAILY, O.GRID, O.LENGTHS, O.RETURNS,
    f"trials AS (SELECT rule, {O._SHARPE.format('ret')} AS s FROM rets GROUP BY 1)", "best AS (SELECT rule FROM trials ORDER BY round(s, 9) DESC, rule LIMIT 1)",
    "a AS (SELECT ret - avg(ret) OVER () AS c, ret FROM rets WHERE rule = (SELECT rule FROM best))",
    "mo AS (SELECT count(*) AS n, avg(ret) / stddev_samp(ret) AS s, avg(c * c * c) / pow(avg(c * c), 1.5) AS g, avg(c * c * c * c) / pow(avg(c * c), 2) AS k FROM a)",
    "t AS (SELECT count(*) AS trials, sqrt(var_samp(s) / 252) AS spread FROM trials)",
    f"b AS (SELECT *, spread * ((1 - {_EULER}) * {_quantile('1 - 1 / CAST(trials AS DOUBLE)')} + {_EULER} * {_quantile('1 - 1 / (trials * exp(1))')}) AS bench, sqrt((1 - g * s + (k - 1) / 4 * s * s) / (n - 1)) AS se FROM mo, t)",
    f"p AS (SELECT *, {_phi('(s - bench) / se')} AS prob FROM b)",
], f"SELECT rule, s * sqrt(252) AS observed_ann, bench * sqrt(252) AS benchmark_ann, prob AS probability_real, trials AS n_trials, n AS n_observations, prob >= 0.95 AS survives, 1 + (1 - g * s + (k - 1) / 4 * s * s) * pow({_quantile('CAST(0.95 AS DOUBLE)')} / s, 2) AS min_track_record FROM p, best")
add("strategy_search_shuffled", "rules# best_by_luck*", [
    DAILY.replace("daily AS", "plain AS"), "moves AS (SELECT idx, value / lag(value) OVER (ORDER BY idx) AS step FROM plain)",
    "dealt AS (SELECT step, row_number() OVER (ORDER BY md5(idx || '/0'), idx) AS idx FROM moves WHERE step IS NOT NULL)",
    "daily AS (SELECT idx, (SELECT value FROM plain WHERE idx = 0) * product(step) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS value FROM dealt UNION ALL SELECT 0, value FROM plain WHERE idx = 0)",
    O.GRID, O.LENGTHS, O.RETURNS, f"trials AS (SELECT rule, {O._SHARPE.format('ret')} AS s FROM rets GROUP BY 1)",
], "SELECT count(*) AS rules, max(s) AS best_by_luck FROM trials")
_OVERLAP = "r AS (" + O._ols("SELECT * FROM fwd WHERE y IS NOT NULL") + ")"
_T = _simpson("pow(1 + @ * @ / v, -(v + 1) / 2)", "abs(t)")
add("regression_verdict", "method n_independent* t* p* significant", [MONTHLY, FORWARD, _OVERLAP,
    "pair AS (SELECT 'ols' AS method, CAST(n AS DOUBLE) AS n_independent, slope / se AS t FROM r UNION ALL SELECT 'effective', n / CAST(12 AS DOUBLE), slope / (se * sqrt(CAST(12 AS DOUBLE))) FROM r)",
    f"q AS (SELECT *, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {_T} AS p FROM (SELECT *, greatest(n_independent - 2, 1) AS v FROM pair))"], "SELECT method, n_independent, t, p, p < 0.05 AS significant FROM q")
_LOG_RANK = SQL["log_rank"]
_DENSITY = "pow(1 + @ * @ / (n - 2), -(n - 1) / CAST(2 AS DOUBLE))"
add("slopes_by_part", "l_partkey slope* t* p* significant", [
    "g AS (SELECT l_partkey, regr_slope(l_discount, l_quantity) AS slope, regr_sxx(l_discount, l_quantity) AS sxx, regr_syy(l_discount, l_quantity) AS syy, regr_sxy(l_discount, l_quantity) AS sxy, count(*) AS n FROM lineitem GROUP BY 1)",
    "e AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS se FROM g WHERE n > 2 AND sxx > 0)", "t AS (SELECT *, CASE WHEN se > 0 THEN slope / se ELSE 0 END AS t FROM e)",
    f"p AS (SELECT *, greatest(1 - 2 * exp(lgamma((n - 1) / CAST(2 AS DOUBLE)) - lgamma((n - 2) / CAST(2 AS DOUBLE))) / sqrt((n - 2) * pi()) * {_simpson(_DENSITY, 'abs(t)')}, 0) AS p FROM t)",
], "SELECT l_partkey, slope, t, p, p < 0.05 AS significant FROM p")
SQL["log_rank_p"] = f"SELECT chi2, round(greatest(2 * (1 - {_phi('sqrt(chi2)')}), 0), 6) + 0.0 AS p_value FROM ({_LOG_RANK})"

# --- pricing

for _name, _mean, _where in (("severity_by_segment", "sum(amount) / sum(claims)", "WHERE claims > 0 AND amount > 0"), ("tweedie_by_segment", "sum(amount) / sum(exposure)", "")):
    add(_name, "term relativity*", [POLICIES, f"r AS (SELECT segment, {_mean} AS rate, row_number() OVER (ORDER BY segment) AS k FROM policies {_where} GROUP BY 1)"],
        "SELECT CASE WHEN k = 1 THEN 'intercept' ELSE 'segment=' || segment END AS term, round(CASE WHEN k = 1 THEN rate ELSE rate / (SELECT rate FROM r WHERE k = 1) END, 4) AS relativity FROM r")
add("priced_gini", "gini*", [POLICIES, "e AS (SELECT round(predicted / greatest(exposure, 1e-9), 12) AS rate, sum(actual) AS l, sum(exposure) AS e FROM priced GROUP BY 1)",
    "c AS (SELECT l, e, sum(l) OVER (ORDER BY rate) / sum(l) OVER () AS cl, lag(rate) OVER (ORDER BY rate) AS before, sum(l) OVER () AS tl, sum(e) OVER () AS te FROM e)"],
    "SELECT 1 - 2 * sum(CASE WHEN before IS NULL THEN 0 ELSE e / te * (2 * cl - l / tl) / 2 END) AS gini FROM c")

# --- calibrators, on scores with few values

_CALIBRATED = [
    SCORED, "counts AS (SELECT score, count(*) AS n, sum(y) AS s FROM scored WHERE id % 2 = 0 GROUP BY 1)",
    "z AS (SELECT score, n, s, ln(c / (1 - c)) AS z FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, score)) AS c FROM counts))",
    """newton(k, a, b) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT any_value(k) AS k, any_value(a) AS a, any_value(b) AS b, sum(s - n * p) AS g0, sum((s - n * p) * z) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * z) AS h01, sum(n * p * (1 - p) * z * z) AS h11
        FROM (SELECT newton.*, z.*, 1 / (1 + exp(-(a + b * z))) AS p FROM newton, z WHERE k < 30)) WHERE h00 IS NOT NULL)""",
    "runs AS (SELECT x.score AS lo, y.score AS hi, sum(t.s) / sum(t.n) AS mean FROM counts x JOIN counts y ON x.score <= y.score JOIN counts t ON t.score BETWEEN x.score AND y.score GROUP BY 1, 2)",
    "iso AS (SELECT score, max(low) AS p FROM (SELECT c.score, lo, min(mean) AS low FROM counts c JOIN runs ON lo <= c.score AND hi >= c.score GROUP BY 1, 2) GROUP BY 1)",
    "test AS (SELECT * FROM scored WHERE id % 2 = 1)",
    """judged AS (
  SELECT 'uncalibrated' AS method, y, score FROM test UNION ALL
  SELECT 'platt', y, 1 / (1 + exp(-(a + b * ln(c / (1 - c))))) FROM (SELECT y, greatest(1e-6, least(1 - 1e-6, score)) AS c FROM test), (SELECT a, b FROM newton ORDER BY k DESC LIMIT 1) UNION ALL
  SELECT 'isotonic', y, p FROM test JOIN iso USING (score))""",
    "each AS (SELECT method, score, count(*) AS n, sum(y) AS pos FROM judged GROUP BY 1, 2)",
    "areas AS (SELECT method, sum(pos * (below - (n - pos) / CAST(2 AS DOUBLE))) / CAST(sum(pos) * sum(n - pos) AS DOUBLE) AS auc FROM (SELECT *, sum(n - pos) OVER (PARTITION BY method ORDER BY score ROWS UNBOUNDED PRECEDING) AS below FROM each) GROUP BY 1)",
    "briers AS (SELECT method, avg((score - y) * (score - y)) AS brier FROM judged GROUP BY 1)",
    "edges AS (SELECT method, list_sort(list_distinct(quantile_cont(score, [" + ", ".join(repr(k / 12) for k in range(13)) + "]))) AS e FROM judged GROUP BY 1)",
    "bins AS (SELECT j.method, len(list_filter(e[2:len(e)-1], lambda x: x <= score)) AS bin, avg(score) AS predicted, avg(y) AS observed, count(*) AS n FROM judged j JOIN edges USING (method) GROUP BY 1, 2)",
    "errors AS (SELECT method, sum(n * abs(predicted - observed)) / sum(n) AS ece, max(abs(predicted - observed)) AS mce FROM bins GROUP BY 1)",
]
add("calibration_report", "method auc* brier* ece* mce*", _CALIBRATED, "SELECT * FROM areas JOIN briers USING (method) JOIN errors USING (method)")
SQL["calibration_report"] = SQL["calibration_report"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- vectors

VECTORS = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
CELLS = "cells AS (SELECT id, unnest(range(len(x))) AS i, unnest(x) AS x FROM v)"
LOF = """d AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) WHERE r <= 20),
kd AS (SELECT i AS j, max(d) AS kd FROM knn GROUP BY 1),
lrd AS (SELECT i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM knn JOIN kd USING (j) GROUP BY 1),
lof AS (SELECT k.i AS id, avg(t.lrd) / any_value(o.lrd) AS score FROM knn k JOIN lrd t ON t.i = k.j JOIN lrd o ON o.i = k.i GROUP BY 1)"""
#: The inverse covariance by Gauss and Jordan, one pivot a step.
MAHALANOBIS = """means AS (SELECT i, avg(x) AS m FROM cells GROUP BY 1), c AS (SELECT id, i, x - m AS x FROM cells JOIN means USING (i)),
inv(k, i, j, v) AS (
  SELECT CAST(-1 AS BIGINT), a.i, b.i, sum(a.x * b.x) / count(*) FROM c a JOIN c b USING (id) GROUP BY 2, 3 UNION ALL
  SELECT s.k + 1, s.i, s.j, CASE WHEN s.i = s.k + 1 AND s.j = s.k + 1 THEN 1 / p.v WHEN s.i = s.k + 1 THEN s.v / p.v WHEN s.j = s.k + 1 THEN -s.v / p.v ELSE s.v - r.v * q.v / p.v END
  FROM inv s JOIN inv r ON r.i = s.i AND r.j = s.k + 1 JOIN inv q ON q.i = s.k + 1 AND q.j = s.j JOIN inv p ON p.i = s.k + 1 AND p.j = s.k + 1),
maha AS (SELECT a.id, sum(a.x * v * b.x) AS score FROM c a JOIN inv ON a.i = inv.i AND inv.k = (SELECT max(i) FROM means) JOIN c b ON b.id = a.id AND b.i = inv.j GROUP BY 1)"""


def _recursive(name: str) -> None:
    SQL[name] = SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


add("local_outlier_factor", "id score*", [VECTORS, LOF], "SELECT * FROM lof")
add("mahalanobis", "id score*", [VECTORS, CELLS, MAHALANOBIS], "SELECT * FROM maha")
add("detector_precision", "k# precision* recall* lift*", [VECTORS, CELLS, MAHALANOBIS, "o AS (SELECT CAST(label = 0 AS INT) AS y, row_number() OVER (ORDER BY score DESC, id) AS r FROM maha JOIN v USING (id))"],
    "SELECT k, h / CAST(k AS DOUBLE) AS precision, h / CAST(p AS DOUBLE) AS recall, h / CAST(k AS DOUBLE) / b AS lift FROM (SELECT k, sum(y) FILTER (r <= k) AS h, sum(y) AS p, avg(y) AS b FROM o, (SELECT unnest([10, 25, 50, 100]) AS k) GROUP BY 1)")
add("detectors_agree", "a b overlap* rank_correlation*", [VECTORS, CELLS, LOF, MAHALANOBIS,
    "o AS (SELECT m.id, row_number() OVER (ORDER BY m.score DESC, m.id) AS ta, row_number() OVER (ORDER BY l.score DESC, l.id) AS tb, row_number() OVER (ORDER BY m.score, m.id) AS ra, row_number() OVER (ORDER BY l.score, l.id) AS rb FROM maha m JOIN lof l USING (id))"],
    "SELECT 'mahalanobis' AS a, 'lof' AS b, count(*) FILTER (ta <= 25 AND tb <= 25) / CAST(25 AS DOUBLE) AS overlap, corr(ra, rb) AS rank_correlation FROM o")
for _name in ("mahalanobis", "detector_precision", "detectors_agree"):
    _recursive(_name)
add("projection_quality", "trustworthiness* overlap* correlation*", [VECTORS,
    "d AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.x, b.x), 9) AS d, round(list_distance(a.x[1:8], b.x[1:8]), 9) AS f FROM v a JOIN v b ON a.id <> b.id)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS rd, row_number() OVER (PARTITION BY i ORDER BY f, j) - 1 AS rf FROM d)", "n AS (SELECT count(*) AS n FROM v)"],
    "SELECT 1 - 2 / CAST(any_value(n) * 12 * (2 * any_value(n) - 37) AS DOUBLE) * sum(CASE WHEN rf < 12 AND rd >= 12 THEN rd - 12 ELSE 0 END) AS trustworthiness, count(*) FILTER (rf < 12 AND rd < 12) / CAST(12 * any_value(n) AS DOUBLE) AS overlap, corr(d, f) AS correlation FROM r, n")
add("pca_rebuilt", "i# j# value*", [VECTORS, CELLS], "SELECT a.i, b.i AS j, corr(a.x, b.x) / 64 AS value FROM cells a JOIN cells b ON a.id = b.id AND a.i <= b.i GROUP BY 1, 2")
add("svd_rebuilt", "i# j# value*", [VECTORS, CELLS, "t AS (SELECT sum(x * x) AS t FROM cells)"], "SELECT a.i, b.i AS j, sum(a.x * b.x) / any_value(t) AS value FROM cells a JOIN cells b ON a.id = b.id AND a.i <= b.i, t GROUP BY 1, 2")
add("pca_needed", "components# mse*", [VECTORS, CELLS], "SELECT count(DISTINCT i) AS components, CAST(0 AS DOUBLE) AS mse FROM cells")
add("customer_matrix", "id total*", [LEDGER, "b AS (SELECT * FROM ledger WHERE NOT is_return AND customer IS NOT NULL)", "t AS (SELECT item FROM b GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 120)",
    "p AS (SELECT * FROM b WHERE item IN (SELECT item FROM t))", "c AS (SELECT customer FROM p GROUP BY 1 ORDER BY count(*) DESC, customer LIMIT 700)"], "SELECT customer AS id, sum(quantity) AS total FROM p WHERE customer IN (SELECT customer FROM c) GROUP BY 1")

# --- recommenders and encodings

_RANDOM = """recs AS (SELECT "user", item, rank FROM (
  SELECT u."user", i.item, row_number() OVER (PARTITION BY u."user" ORDER BY CAST('0x' || substr(md5(u."user" || '/' || i.item || '/0'), 1, 8) AS BIGINT) DESC, i.item) - 1 AS rank
  FROM (SELECT DISTINCT "user" FROM test) u CROSS JOIN (SELECT DISTINCT item FROM train) i LEFT JOIN seen s ON s."user" = u."user" AND s.item = i.item WHERE s.item IS NULL) WHERE rank < 10)"""
add("ranking_random", "precision* recall* ndcg* coverage* novelty* users#", [INTERACTIONS, _RANDOM, RANKING], O._SCORE)
_WAYS = {"naive": "encoding_naive", "smoothed": "encoding_smoothed", "out_of_fold": "encoding_out_of_fold"}
#: A rising curve keeps the order of the encoded column, a falling one turns it round.
SQL["fit_and_score"] = (
    "WITH e AS (" + " UNION ALL ".join(f"SELECT '{way}' AS way, split, y, encoded FROM ({SQL[name].replace('round(encoded, 6) + 0.0 AS encoded', 'encoded')})" for way, name in _WAYS.items()) + "), "
    "s AS (SELECT way, CASE WHEN covar_pop(encoded, y) FILTER (split = 'train') >= 0 THEN 1 ELSE -1 END AS s FROM e GROUP BY 1), "
    "each AS (SELECT way, split, round(encoded * s, 9) AS score, count(*) AS n, sum(y) AS pos FROM e JOIN s USING (way) GROUP BY 1, 2, 3), "
    "a AS (SELECT way, split, sum(pos * (below - (n - pos) / CAST(2 AS DOUBLE))) / CAST(sum(pos) * sum(n - pos) AS DOUBLE) AS auc FROM (SELECT *, sum(n - pos) OVER (PARTITION BY way, split ORDER BY score ROWS UNBOUNDED PRECEDING) AS below FROM each) GROUP BY 1, 2) "
    "SELECT way, round(max(auc) FILTER (split = 'train'), 6) AS train_auc, round(max(auc) FILTER (split = 'test'), 6) AS test_auc FROM a GROUP BY 1"
)
add("category_codes", "p_partkey p_brand_code# p_type_code#", [], "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type_code FROM part")
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
add("short_names", "p_partkey short", [f"t AS (SELECT p_partkey, {_TITLE} AS t FROM part)"], "SELECT p_partkey, CASE WHEN length(t) > 12 THEN t[1:11] || '…' ELSE t END AS short FROM t")

# --- readers

add("csv_reader", "c_custkey c_name c_nationkey# c_acctbal* c_mktsegment", [], "SELECT * FROM customer")
add("zip_reader", "n_nationkey# n_name n_regionkey#", [], "SELECT * FROM nation")
add("arff_reader", "n_name n_nationkey*", [], "SELECT n_name, CAST(n_nationkey AS DOUBLE) AS n_nationkey FROM nation UNION ALL SELECT '@odd', NULL")
SQL["source_status"] = "SELECT name, url, name <> 'missing' AS cached, CASE WHEN name <> 'missing' THEN strlen(name) END AS bytes, CASE WHEN name <> 'missing' THEN sha256(name) END AS sha256 FROM (VALUES ('region', 'r'), ('nation', 'n'), ('missing', 'm')) t(name, url)"
add("clean_retail", "is_return lines# codes# revenue*", [], "SELECT l_returnflag = 'R' AS is_return, count(*) AS lines, count(DISTINCT CASE WHEN l_linenumber <> 6 THEN l_partkey END) AS codes, round(sum(l_quantity * (l_extendedprice - 5000)), 2) AS revenue FROM lineitem WHERE l_linenumber <> 7 AND l_extendedprice > 5000 GROUP BY 1")
add("clean_motor", '"ClaimNb"# policies# exposure*', [], 'SELECT least(c_custkey % 7, 4) AS "ClaimNb", count(*) AS policies, sum(least(c_custkey % 30 / CAST(20 AS DOUBLE), 1)) AS exposure FROM customer GROUP BY 1')

# --- penalised fits: what an optimum must satisfy

_PRIME = (1 << 31) - 1
_CUTS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
_REPLICATES = "draws(model, a, b) AS (VALUES " + ", ".join(
    [f"('{p}/0.002', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT))" for p in ("none", "l2", "l1", "elasticnet")] + [f"('replicate/{r}', {pow(16_807, r + 1, _PRIME)}, {pow(48_271, r + 1, _PRIME)})" for r in range(6)]
) + ")"
_STANDARD = "standard AS (" + " UNION ALL ".join(
    f"SELECT id, key, y, '{c}' AS \"column\", ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x FROM derived" for c in O._DERIVED
) + " UNION ALL SELECT id, key, y, 'intercept', 1.0 FROM derived)"
add("penalty_conditions", 'model "column" moment*', [
    "derived AS (SELECT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12) AS BIGINT) % 2147483647 AS key, y, " + ", ".join(O._DERIVED) + " FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_returnflag = 'R' AS INT) AS y, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in O._DERIVED.items()) + " FROM lineitem))",
    _STANDARD, _REPLICATES,
    "weighted AS (SELECT model, id, " + " + ".join(f"CAST((key * a + b) % {_PRIME} >= {math.floor(c * _PRIME)} AS INT)" for c in _CUTS) + " AS m FROM (SELECT DISTINCT id, key FROM standard), draws)",
], "SELECT model, \"column\", round(sum(coalesce(m, 1) * x * y), 2) AS moment FROM standard JOIN weighted USING (id) GROUP BY 1, 2")


# --- the filter, step by step: a state of two numbers and its covariance


def _filter(model: str, a: float, b: float, m: float) -> str:
    """ARMA(2, 1): state (x, y), x' = a x + y + e, y' = b x + m e; the start is the stationary covariance."""
    # Stationary: P11 = a2 P11 + 2a P12 + P22 + 1; P12 = a b P11 + b P12 + m; P22 = b2 P11 + m2.
    p11 = (1 + m * m + 2 * a * m / (1 - b)) / (1 - a * a - b * b - 2 * a * a * b / (1 - b))
    p12, p22 = (a * b * p11 + m) / (1 - b), b * b * p11 + m * m
    n = lambda v: f"CAST({v!r} AS DOUBLE)"
    return f"""f{model}(idx, innovation, variance, x, y, p, q, r) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), {n(p11)}, {n(p12)}, {n(p22)}
  UNION ALL
  SELECT idx, e, p, {n(a)} * x1 + y1, {n(b)} * x1, r1 + 1, CAST({m!r} AS DOUBLE), CAST({m * m!r} AS DOUBLE)
  FROM (SELECT z.idx AS idx, v - x AS e, p, x + (v - x) AS x1, y + q / p * (v - x) AS y1, r - q * q / p AS r1 FROM f{model} f JOIN z ON z.idx = f.idx + 1))"""


add("kalman_innovations", "model idx# innovation* variance*", [
    MONTHLY, "steps AS (SELECT idx, value - lag(value) OVER (ORDER BY idx) AS v FROM monthly)",
    "z AS (SELECT idx, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v FROM steps WHERE v IS NOT NULL)",
    _filter("101", 0.5, 0.0, 0.4), _filter("201", 0.3, -0.2, -0.6),
], "SELECT '101' AS model, idx, innovation, variance FROM f101 WHERE idx > 0 UNION ALL SELECT '201', idx, innovation, variance FROM f201 WHERE idx > 0")
SQL["kalman_innovations"] = SQL["kalman_innovations"].replace("WITH ", "WITH RECURSIVE ", 1)


# --- sources and streams

SQL["workbook_reader"] = f"""WITH {MONTHLY}
SELECT 'Nations' AS sheet, n_name AS label, CAST(n_nationkey AS BIGINT) AS number, CAST(NULL AS DOUBLE) AS amount FROM nation
UNION ALL SELECT 'Months & more', CAST(month AS VARCHAR), CAST(x AS BIGINT), round(value, 6) + 0.0 FROM monthly"""
SQL["fetch_cache"] = f"""WITH {MONTHLY}, f AS (SELECT CAST(month AS VARCHAR) AS name, month || ' ' || CAST(x AS BIGINT) AS body FROM monthly)
SELECT name, 'orders' AS note, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256, CAST(1 AS BIGINT) AS times, name || '.txt' AS file FROM f"""
add("streaming_volatility", "user_id event_id volatility*", [], "SELECT user_id, event_id, CASE WHEN count(*) OVER w = 21 THEN stddev_samp(value) OVER w * sqrt(252) END AS volatility FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")


# --- the permutation null: pools in the order of affine maps of MD5 keys

_KEY = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT) % 2147483647"
add("permutation_null", "replicate rules# max_lift* p99_lift* median_lift* share_over_2*", [
    BASKETS, f"keyed AS (SELECT basket, item, {_KEY.format('CAST(basket AS VARCHAR)')} % (SELECT greatest(1, count(*) // 50000) FROM baskets) AS bucket, {_KEY.format(chr(39).join(['basket || ', '/', ' || item']))} AS key FROM baskets)",
    "draws(replicate, a, b) AS (VALUES " + ", ".join(f"({r}, {pow(16_807, r + 1, _PRIME)}, {pow(48_271, r + 1, _PRIME)})" for r in range(20)) + ")",
    f"ranked AS (SELECT replicate, bucket, basket, item, row_number() OVER (PARTITION BY replicate, bucket ORDER BY basket, item) AS k, row_number() OVER (PARTITION BY replicate, bucket ORDER BY (key * a + b) % {_PRIME}, basket, item) AS j FROM keyed, draws)",
    "dealt AS (SELECT DISTINCT s.replicate, s.basket, p.item FROM ranked s JOIN ranked p ON s.replicate = p.replicate AND s.bucket = p.bucket AND s.k = p.j)",
    "counts AS (SELECT replicate, item, count(*) AS n FROM dealt GROUP BY 1, 2)", "sized AS (SELECT * FROM dealt JOIN counts USING (replicate, item))",
    "pairs AS (SELECT x.replicate, x.n AS na, y.n AS nb, x.item AS a, y.item AS b, count(*) AS n FROM sized x JOIN sized y ON x.replicate = y.replicate AND x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5)",
    "total AS (SELECT replicate, count(DISTINCT basket) AS t FROM dealt GROUP BY 1)", "lifts AS (SELECT replicate, n * t / CAST(na * nb AS DOUBLE) AS lift FROM pairs JOIN total USING (replicate))",
], "SELECT replicate, 2 * count(*) AS rules, max(lift) AS max_lift, quantile_cont(lift, 0.99) AS p99_lift, quantile_cont(lift, 0.5) AS median_lift, avg(CAST(lift > 2 AS DOUBLE)) AS share_over_2 FROM lifts GROUP BY 1")


# --- fitted models: margins of GLMs, Newton's steps of a Cox regression written out

add("glm_margins", "model factor level total*", [
    POLICIES, "q AS (SELECT quantile_cont(nation, [0.2, 0.4, 0.6, 0.8]) AS c FROM policies WHERE exposure > 0)",
    f"b AS (SELECT {O._BAND} AS balance_band, 'nat' || (len(list_filter(c, lambda v: v < nation)) + 1) AS nation_band, segment, claims, amount FROM policies, q WHERE exposure > 0)",
    "l AS (SELECT claims, amount, unnest([{'f': 'segment', 'l': segment}, {'f': 'nation_band', 'l': nation_band}, {'f': 'balance_band', 'l': balance_band}]) AS u FROM b WHERE balance_band IS NOT NULL AND nation_band IS NOT NULL)",
], "SELECT 'frequency' AS model, u.f AS factor, u.l AS level, CAST(sum(claims) AS DOUBLE) AS total FROM l GROUP BY ALL UNION ALL SELECT 'severity', u.f, u.l, CAST(sum(claims) AS DOUBLE) FROM l WHERE claims > 0 AND amount > 0 GROUP BY ALL")


def _cox(steps: int) -> list[str]:
    """Two covariates by Breslow's likelihood: each step adds up the risk sets at the coefficients before."""
    parts = ["x AS (SELECT duration AS t, CAST(observed AS INT) AS d, first_value / 100000 AS x, CAST(first_items AS DOUBLE) AS y FROM gaps)", "b0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]
    for k in range(steps):
        parts.append(f"""s{k} AS (SELECT t, sum(d) AS d, sum(d * x) AS dx, sum(d * y) AS dy, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy
  FROM (SELECT x.*, exp(greatest(-30, least(30, a * x + b * y))) AS w FROM x, b{k}) GROUP BY t),
r{k} AS (SELECT d, dx, dy, """ + ", ".join(f"sum({c}) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("w", "wx", "wy", "wxx", "wxy", "wyy")) + f""" FROM s{k}),
g{k} AS (SELECT sum(dx - d * wx / w) AS gx, sum(dy - d * wy / w) AS gy, sum(d * (wxx / w - wx / w * wx / w)) AS hxx, sum(d * (wxy / w - wx / w * wy / w)) AS hxy, sum(d * (wyy / w - wy / w * wy / w)) AS hyy FROM r{k} WHERE d > 0),
b{k + 1} AS (SELECT a + (hyy * gx - hxy * gy) / (hxx * hyy - hxy * hxy) AS a, b + (hxx * gy - hxy * gx) / (hxx * hyy - hxy * hxy) AS b, sqrt(hyy / (hxx * hyy - hxy * hxy)) AS ea, sqrt(hxx / (hxx * hyy - hxy * hxy)) AS eb FROM b{k}, g{k})""")
    return parts


add("cox_regression", "covariate coefficient* hazard_ratio* lower* upper* z* p_value*", [LEDGER, GAPS, *_cox(8), "found AS (SELECT 'value' AS covariate, a AS c, ea AS e FROM b8 UNION ALL SELECT 'items', b, eb FROM b8)"],
    f"SELECT covariate, c AS coefficient, exp(c) AS hazard_ratio, exp(c - 1.96 * e) AS lower, exp(c + 1.96 * e) AS upper, c / e AS z, greatest(2 * (1 - {_phi('abs(c / e)')}), 0) AS p_value FROM found")


# --- calendars, frames and features

add("trading_calendar", "day value* closed open_idx#", ["o AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)",
    "c AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM o), (SELECT max(d) FROM o), INTERVAL 1 DAY)) AS DATE) AS d)", "f AS (SELECT c.d AS d, coalesce(v, 0) AS v FROM c LEFT JOIN o ON c.d = o.d)"],
    "SELECT CAST(d AS VARCHAR) AS day, v AS value, v = 0 AS closed, CASE WHEN v <> 0 THEN count(*) FILTER (v <> 0) OVER (ORDER BY d) - 1 END AS open_idx FROM f")
add("motor_frames", "policy# exposure* claim_nb* area claims# amount*", [POLICIES, "sev AS (SELECT o_custkey AS p, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)"],
    "SELECT policy, least(exposure * 1.5, 1) AS exposure, CAST(least(claims + 1, 4) AS DOUBLE) AS claim_nb, segment AS area, coalesce(n, 0) AS claims, coalesce(s, 0) AS amount FROM policies LEFT JOIN sev ON policy = p")
add("bank_features", "label age# job poutcome balance*", ["c AS (SELECT c_custkey AS age, c_mktsegment AS job, CASE WHEN c_nationkey > 3 THEN 'n' || c_nationkey END AS poutcome, c_acctbal AS balance FROM customer)",
    "codes AS (SELECT *, " + ", ".join(f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) - 1 END AS {c}_code" for c in ("job", "poutcome")) + " FROM c)"],
    "SELECT CAST(balance > 5000 AS INT) AS label, age, CAST(job_code AS INT) AS job, CAST(poutcome_code AS INT) AS poutcome, balance FROM codes")
_ENGINEERED = {"air_temp": "air", "process_temp": "process", "temp_difference": "process - air", "temp_ratio": "process / air", "speed": "speed", "torque": "torque", "power": "torque * speed * (2 * pi() / 60)", "log_power": "ln(1 + torque * speed * (2 * pi() / 60))", "tool_wear": "wear", "wear_x_torque": "wear * torque", "wear_squared": "wear * wear", "torque_per_rpm": "torque / speed", "is_low_quality": "CAST(grade = 'L' AS DOUBLE)", "is_high_quality": "CAST(grade = 'H' AS DOUBLE)"}
add("engineered_features", "feature mean* with_y*", [
    "m AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_quantity + 270 AS DOUBLE) AS air, CAST(l_quantity + 270 + l_tax * 100 AS DOUBLE) AS process, CAST(l_extendedprice / 50 + 100 AS DOUBLE) AS speed, CAST(l_discount * 500 + 3 AS DOUBLE) AS torque, CAST(l_suppkey AS DOUBLE) AS wear, CASE WHEN l_linestatus = 'O' THEN 'L' WHEN l_linenumber = 1 THEN 'H' ELSE 'M' END AS grade FROM lineitem)",
], " UNION ALL ".join(f"SELECT '{n}' AS feature, avg({e}) AS mean, avg(({e}) * y) AS with_y FROM m" for n, e in _ENGINEERED.items()))
