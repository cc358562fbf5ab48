"""DuckDB SQL of the queries that SQL can express, on the same tables and rounded alike."""

from __future__ import annotations

SQL: dict[str, str] = {}

LEDGER = """ledger AS (
  SELECT l_orderkey AS invoice, l_linenumber AS line, o_custkey AS customer, l_partkey AS item, o_orderdate AS ts, l_returnflag = 'R' AS is_return,
         CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END * l_quantity AS quantity, l_extendedprice / l_quantity AS price,
         CASE WHEN l_returnflag = 'R' THEN CAST(-1.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END * l_extendedprice * (1 - l_discount) AS revenue, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DAILY = """daily AS (
  SELECT *, row_number() OVER (ORDER BY day) - 1 AS idx FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1))"""
MONTHLY = """monthly AS (
  SELECT *, row_number() OVER (ORDER BY month) - 1 AS idx
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1))"""
SCORED = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_returnflag = 'R' AS INT) AS y, l_discount * 10 AS score FROM lineitem)"""
SCORED_DOCS = """scored AS (
  SELECT doc_id AS id, CAST(quality AS INT) AS y, n_chars / CAST((SELECT max(n_chars) FROM documents) AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"""
MATCHES = """events_i AS (SELECT user_id, CAST(floor(value / 25) AS INT) AS goals, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
matches AS (
  SELECT a.i // 2 AS idx, a.user_id AS home, b.user_id AS away, a.goals AS hg, b.goals AS ag,
         CASE WHEN a.goals > b.goals THEN 0 WHEN a.goals = b.goals THEN 1 ELSE 2 END AS outcome
  FROM events_i a JOIN events_i b ON b.i = a.i + 1 AND a.i % 2 = 0),
odds AS (SELECT *, 1.5 + (idx % 7) * CAST(0.25 AS DOUBLE) AS o0, 3.0 + (idx % 3) * CAST(0.3 AS DOUBLE) AS o1, 2.0 + (idx % 5) * CAST(0.4 AS DOUBLE) AS o2 FROM matches),
implied AS (SELECT *, 1 / o0 / (1 / o0 + 1 / o1 + 1 / o2) AS p0, 1 / o1 / (1 / o0 + 1 / o1 + 1 / o2) AS p1, 1 / o2 / (1 / o0 + 1 / o1 + 1 / o2) AS p2 FROM odds)"""
POLICIES = """o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
span AS (SELECT min(d) AS lo, max(d) AS hi FROM o), firsts AS (SELECT o_custkey, min(d) AS first FROM o GROUP BY 1),
claims AS (SELECT o_custkey, count(*) AS n, sum(l_extendedprice) AS amount FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1),
policies AS (
  SELECT c_custkey AS policy, greatest(least((hi - first) / CAST(hi - lo AS DOUBLE), 1.0), 0.001) AS exposure, CAST(least(coalesce(n, 0), 4) AS BIGINT) AS claims,
         coalesce(amount, 0.0) AS amount, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance
  FROM customer JOIN firsts f ON c_custkey = f.o_custkey CROSS JOIN span LEFT JOIN claims k ON c_custkey = k.o_custkey),
priced AS (
  SELECT policy AS id, exposure, CAST(claims AS DOUBLE) AS actual, rate * exposure AS predicted
  FROM policies JOIN (SELECT segment, sum(claims) / sum(exposure) AS rate FROM policies GROUP BY 1) USING (segment))"""
BASKETS = """lines AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
baskets AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY basket) AS size FROM lines) WHERE size > 1)"""
INTERACTIONS = """raw AS (
  SELECT o_custkey AS "user", p_brand || '/' || p_type AS item, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
kept AS (SELECT * FROM raw WHERE "user" IN (SELECT "user" FROM raw GROUP BY 1 HAVING count(*) >= 5) AND item IN (SELECT item FROM raw GROUP BY 1 HAVING count(*) >= 10)),
sides AS (SELECT *, CASE WHEN epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts), 0.8) FROM kept) THEN 'train' ELSE 'test' END AS role FROM kept),
train AS (SELECT * FROM sides WHERE role = 'train'), test AS (SELECT * FROM sides WHERE role = 'test'),
seen AS (SELECT DISTINCT "user", item FROM train)"""


def add(name: str, columns: str, ctes: list[str], select: str) -> None:
    """Register a query: ``columns`` lists the outputs, doubles marked with * (rounded) and counts with # (BIGINT)."""
    out = []
    for c in columns.split():
        bare = c.strip("*#")
        out.append(f'round({bare}, 6) + 0.0 AS {bare}' if c.endswith("*") else f"CAST({bare} AS BIGINT) AS {bare}" if c.endswith("#") else bare)
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    SQL[name] = f"{head}SELECT {', '.join(out)} FROM ({select})"


# --- customer value


def _rfm(where: str = "") -> str:
    return f"""rfm AS (
  SELECT customer, epoch_us(s.as_of - last) // 86400000000 AS recency_days, epoch_us(s.as_of - first) // 86400000000 AS tenure_days, frequency, monetary, returned,
         monetary / greatest(frequency, 1) AS avg_order_value, greatest(0.0, least(1.0, returned / greatest(abs(monetary), 0.01))) AS return_rate
  FROM (SELECT customer, max(ts) AS last, min(ts) AS first, count(DISTINCT invoice) AS frequency, sum(revenue) AS monetary, coalesce(-sum(revenue) FILTER (is_return), 0.0) AS returned
        FROM ledger {where} GROUP BY 1), (SELECT max(ts) + INTERVAL 1 DAY AS as_of FROM ledger {where}) s)"""


RFM_COLUMNS = "customer recency_days# tenure_days# frequency# monetary* returned* avg_order_value* return_rate*"
add("rfm", RFM_COLUMNS, [LEDGER, _rfm()], "SELECT * FROM rfm")
add("rfm_purchases_only", RFM_COLUMNS, [LEDGER, _rfm("WHERE NOT is_return")], "SELECT * FROM rfm")
add("value_at_risk", RFM_COLUMNS, [LEDGER, _rfm()], "SELECT * FROM rfm WHERE recency_days >= 180 AND frequency >= 2")
add("one_time_buyers", "share*", [LEDGER, _rfm()], "SELECT avg(CAST(frequency = 1 AS INT)) AS share FROM rfm")
_POSITIVE = "pos AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k, count(*) OVER () AS n, sum(value) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(value) OVER () AS s FROM (SELECT CAST(floor((sum(CAST(round(revenue * 10000) AS BIGINT)) + 50) / 100) AS BIGINT) AS value FROM ledger GROUP BY customer) WHERE value > 0)"
add("concentration", "value* customers* revenue*", [LEDGER, _POSITIVE], "SELECT value / 100 AS value, max(k) / CAST(any_value(n) AS DOUBLE) AS customers, max(upto) / any_value(s) AS revenue FROM pos GROUP BY value")
add("top_share", "share* revenue*", [LEDGER, _POSITIVE], "SELECT share, max(upto / s) FILTER (k = greatest(CAST(floor(share * n) AS BIGINT), 1)) AS revenue FROM pos, (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.5]::DOUBLE[]) AS share) GROUP BY share")
add("value_gini", "gini* n#", [LEDGER, _rfm()], "SELECT 2 * sum(k * monetary) / (count(*) * sum(monetary)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) AS gini, count(*) AS n FROM (SELECT monetary, row_number() OVER (ORDER BY monetary) AS k FROM rfm WHERE monetary > 0)")


def _cohorts(stop: str) -> str:
    return f"""m AS (SELECT customer, CAST(date_trunc('month', ts) AS DATE) AS month, sum(revenue) AS revenue FROM ledger GROUP BY 1, 2),
c AS (SELECT *, min(month) OVER (PARTITION BY customer) AS cohort FROM m),
cells AS (SELECT cohort, date_diff('month', cohort, month) AS months_since, count(*) AS customers, sum(revenue) AS revenue FROM c GROUP BY 1, 2),
grid AS (SELECT cohort, customers AS intake, unnest(range(0, {stop} + 1)) AS months_since FROM cells WHERE months_since = 0),
full_cells AS (
  SELECT g.cohort, g.months_since, coalesce(x.customers, 0) AS customers, coalesce(x.customers, 0) / CAST(intake AS DOUBLE) AS rate, coalesce(x.revenue, 0.0) AS revenue
  FROM grid g LEFT JOIN cells x ON g.cohort = x.cohort AND g.months_since = x.months_since)"""


_SEEN, _ALL = _cohorts("date_diff('month', cohort, (SELECT max(month) FROM m))"), _cohorts("(SELECT max(months_since) FROM cells)")
add("cohorts", "cohort months_since# customers# rate* revenue*", [LEDGER, _SEEN], "SELECT * FROM full_cells")
add("cohorts_zero_fill", "cohort months_since# customers# rate* revenue*", [LEDGER, _ALL], "SELECT * FROM full_cells")
add("average_survival", "months_since# rate*", [LEDGER, _SEEN], "SELECT months_since, avg(rate) AS rate FROM full_cells GROUP BY 1")

# --- metrics

POINTS = """each AS (SELECT score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1),
pts AS (SELECT score, n, pos, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS p, sum(n - pos) OVER () AS m FROM each WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
add("precision_recall", "score* precision* recall*", [SCORED, POINTS], "SELECT score, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(p AS DOUBLE) AS recall FROM pts")
add("average_precision", "average_precision*", [SCORED_DOCS, POINTS], "SELECT sum(pos / CAST(p AS DOUBLE) * tp / (tp + fp)) AS average_precision FROM pts")
add("roc", "score* fpr* tpr*", [SCORED, POINTS], "SELECT score, fp / CAST(m AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM pts")
_WINS = "SELECT sum(pos * (m - fp + (n - pos) / CAST(2 AS DOUBLE))) / CAST(any_value(p) * any_value(m) AS DOUBLE)"
add("roc_area", "area*", [SCORED_DOCS, POINTS], f"{_WINS} AS area FROM pts")
add("tied_auc", "auc*", [SCORED, POINTS], f"{_WINS} AS auc FROM pts")


def _at(thresholds: str, miss: float, alarm: float) -> str:
    return f"""counted AS (
  SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp,
         count(*) FILTER (NOT score >= threshold AND y = 1) AS fn, count(*) FILTER (NOT score >= threshold AND y = 0) AS tn
  FROM scored, (SELECT {thresholds} AS threshold) GROUP BY 1),
costs AS (SELECT *, fn * CAST({miss} AS DOUBLE) + fp * CAST({alarm} AS DOUBLE) AS cost, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy FROM counted)"""


_DECISION = "threshold* cost* tp# fp# fn# tn# recall* precision* accuracy*"
_GRID = "CAST(unnest(range(0, 400)) AS DOUBLE) / 399"
add("evaluate_at", _DECISION, [SCORED, _at("unnest([0.0, 0.25, 0.5, 0.75, 1.5]::DOUBLE[])", 50, 1)], "SELECT * FROM costs")
add("cost_curve", "threshold* cost* tp# fp#", [SCORED, _at(_GRID, 5, 2)], "SELECT * FROM costs")
add("best_threshold", _DECISION, [SCORED_DOCS, _at(_GRID, 1, 6)], "SELECT * FROM costs ORDER BY cost, threshold LIMIT 1")
add("choose_threshold", "threshold* expected_cost* tp# fp# fn# recall*", [SCORED_DOCS, _at("unnest((SELECT list(DISTINCT round(score, 4)) FROM scored))", 1, 6)], "SELECT *, cost AS expected_cost FROM costs ORDER BY cost, threshold LIMIT 1")
add("brier", "brier*", [SCORED_DOCS], "SELECT avg((score - y) * (score - y)) AS brier FROM scored")
add("calibration_curve", "bin# predicted* observed* n#", [SCORED_DOCS], "SELECT b.bin, avg(score) AS predicted, avg(y) AS observed, count(score) AS n FROM range(10) b(bin) LEFT JOIN scored ON bin = len(list_filter(range(1, 10), lambda k: k / CAST(10 AS DOUBLE) <= score)) GROUP BY 1")
_QBIN = """edges AS (SELECT list_sort(list_distinct(quantile_cont(score, [k / 12 FOR k IN range(13)]))) AS e FROM scored),
binned AS (SELECT len(list_filter(e[2:len(e)-1], lambda x: x <= score)) AS bin, avg(score) AS predicted, avg(y) AS observed, count(*) AS n FROM scored, edges GROUP BY 1)"""
_QBIN = _QBIN.replace("[k / 12 FOR k IN range(13)]", "[" + ", ".join(repr(k / 12) for k in range(13)) + "]")
add("quantile_reliability", "bin# predicted* observed* n#", [SCORED_DOCS, _QBIN], "SELECT * FROM binned")
add("calibration_errors", "ece* mce*", [SCORED_DOCS, _QBIN], "SELECT sum(n * abs(predicted - observed)) / sum(n) AS ece, max(abs(predicted - observed)) AS mce FROM binned")


def _lift(share: float) -> str:
    return f"ranked AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS r, greatest(1, CAST(floor(count(*) OVER () * CAST({share} AS DOUBLE)) AS BIGINT)) AS k, avg(y) OVER () AS base FROM scored), cut AS (SELECT any_value(k) AS k, sum(y) AS hits, avg(y) AS precision, any_value(base) AS base FROM ranked WHERE r <= k)"


add("lift_at_k", "lift* precision* k#", [SCORED, _lift(0.1)], "SELECT precision / base AS lift, precision, k FROM cut")
add("campaign_value", "calls# subscriptions# conversion* profit* lift*", [SCORED, _lift(0.2)], "SELECT k AS calls, hits AS subscriptions, precision AS conversion, CAST(hits * 80 - k * 5 AS DOUBLE) AS profit, precision / base AS lift FROM cut")
add("money_at_stake", "expected* actual* error_pct*", [SCORED_DOCS], "SELECT sum(score) * 450 AS expected, sum(y) * CAST(450 AS DOUBLE) AS actual, (sum(score) * 450 - sum(y) * 450) / (sum(y) * 450) * 100 AS error_pct FROM scored")
_AUDIT = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))
add("leak_audit", '"column" solo_auc* available verdict suspicion*', [
    "long AS (SELECT y, u.c AS \"column\", u.s AS score FROM (SELECT CAST(l_returnflag = 'R' AS INT) AS y, unnest(["
    + ", ".join(f"{{'c': '{c}', 's': CAST({e} AS DOUBLE)}}" for c, e in [*((c, c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")), ("returned", "CAST(l_returnflag = 'R' AS INT)")])
    + "]) AS u FROM lineitem))",
    'each AS (SELECT "column", score, count(*) AS n, sum(y) AS pos FROM long GROUP BY 1, 2)',
    'pts AS (SELECT *, sum(n - pos) OVER (PARTITION BY "column" ORDER BY score ROWS UNBOUNDED PRECEDING) AS below FROM each)',
    'a AS (SELECT "column", sum(pos * (below - (n - pos) / CAST(2 AS DOUBLE))) / CAST(sum(pos) * sum(n - pos) AS DOUBLE) AS solo_auc, "column" IN (\'l_quantity\', \'l_extendedprice\', \'l_linenumber\') AS available FROM pts GROUP BY 1)',
], "SELECT *, CASE WHEN NOT (solo_auc >= 0.7 OR solo_auc <= 0.3) THEN 'ok' WHEN available THEN 'check' ELSE 'LEAK' END AS verdict, abs(solo_auc - 0.5) AS suspicion FROM a")

# --- splits


def _split(embargo: int) -> str:
    return f"""f AS (SELECT unnest(range(1, 6)) AS fold, n // 6 AS s FROM (SELECT count(*) AS n FROM daily)),
roles AS (SELECT fold, CASE WHEN idx < s * fold - {embargo} THEN 'train' ELSE 'test' END AS role, idx FROM daily, f WHERE idx < s * fold - {embargo} OR (idx >= s * fold AND idx < s * (fold + 1)))"""


for _name, _gap in (("time_split", 0), ("purged_time_split", 21)):
    add(_name, "fold# role lo# hi# n#", [DAILY, _split(_gap)], "SELECT fold, role, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM roles GROUP BY 1, 2")
add("group_split", "customer sides# held# orders#", ["g AS (SELECT o_custkey AS customer, count(*) AS orders, row_number() OVER (ORDER BY md5(o_custkey || '/0'), o_custkey) AS k, count(*) OVER () AS n FROM orders GROUP BY 1)"],
    "SELECT customer, 1 AS sides, CAST(k <= greatest(1, round_even(n * 0.25, 0)) AS INT) AS held, orders FROM g")

# --- backtests

GRID = """rules AS (
  SELECT kind || '(' || fast || ',' || slow || ')' AS rule, kind, fast, slow
  FROM (SELECT unnest(['crossover', 'momentum', 'reversion']) AS kind), (SELECT unnest(range(2, 31, 2)) AS fast), (SELECT unnest(range(10, 201, 10)) AS slow) WHERE fast < slow)"""
LENGTHS = "lens AS (SELECT fast AS len FROM rules UNION SELECT slow FROM rules)"
RETURNS = """ind AS (
  SELECT d.idx, len, d.value, CASE WHEN d.idx >= len - 1 THEN avg(w.value) END AS ma, CASE WHEN d.idx >= len - 1 THEN stddev_samp(w.value) END AS sd, d.value / any_value(b.value) - 1 AS change
  FROM daily d CROSS JOIN lens JOIN daily w ON w.idx BETWEEN d.idx - len + 1 AND d.idx LEFT JOIN daily b ON b.idx = d.idx - len GROUP BY d.idx, len, d.value),
sig AS (
  SELECT rule, kind, r.fast, r.slow, f.idx, f.value, coalesce(CASE kind WHEN 'crossover' THEN f.ma > s.ma WHEN 'momentum' THEN s.change > 0 AND f.change > 0 ELSE CASE WHEN s.sd > 0 THEN (f.value - s.ma) / s.sd < -1 END END, FALSE) AS on_
  FROM rules r JOIN ind f ON f.len = r.fast JOIN ind s ON s.len = r.slow AND s.idx = f.idx),
held AS (SELECT *, coalesce(lag(CAST(on_ AS DOUBLE)) OVER w, 0.0) AS held, coalesce(value / lag(value) OVER w - 1, 0.0) AS market FROM sig WINDOW w AS (PARTITION BY rule ORDER BY idx)),
rets AS (SELECT *, held * market - coalesce(abs(held - lag(held) OVER (PARTITION BY rule ORDER BY idx)), 0.0) * CAST(0.0005 AS DOUBLE) AS ret FROM held)"""
add("rule_grid", "kind fast# slow# rule", [GRID], "SELECT * FROM rules")
_SHARPE = "coalesce(CASE WHEN count({0}) >= 2 AND stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) END, 0.0)"
add("strategy_search", "rule kind fast# slow# sharpe_ann* total_return* days_active*", [DAILY, GRID, LENGTHS, RETURNS], f"SELECT rule, kind, fast, slow, {_SHARPE.format('ret')} AS sharpe_ann, product(1 + ret) - 1 AS total_return, avg(CAST(ret <> 0 AS INT)) AS days_active FROM rets GROUP BY 1, 2, 3, 4")
_HALF = "(SELECT count(*) // 2 FROM daily)"
add("search_halves", "rule in_sample* out_of_sample*", [DAILY, GRID, LENGTHS, RETURNS], f"SELECT rule, {_SHARPE.format('a')} AS in_sample, {_SHARPE.format('b')} AS out_of_sample FROM (SELECT rule, CASE WHEN idx < {_HALF} THEN ret END AS a, CASE WHEN idx >= {_HALF} THEN ret END AS b FROM rets) GROUP BY 1")
add("return_moments", "n# sharpe_pp* skew* kurtosis*", [DAILY, "r AS (SELECT value / lag(value) OVER (ORDER BY idx) - 1 AS ret FROM daily)", "c AS (SELECT ret - (SELECT avg(ret) FROM r) AS e, ret FROM r WHERE ret IS NOT NULL)"], "SELECT count(*) AS n, avg(ret) / stddev_samp(ret) AS sharpe_pp, avg(e * e * e) / pow(avg(e * e), 1.5) AS skew, avg(e * e * e * e) / pow(avg(e * e), 2) AS kurtosis FROM c")

# --- forecasts of matches

add("odds_probabilities", "idx# p_home* p_draw* p_away* overround*", [MATCHES], "SELECT idx, p0 AS p_home, p1 AS p_draw, p2 AS p_away, 1 / o0 + 1 / o1 + 1 / o2 AS overround FROM implied")
_SCORES = """SELECT avg((p0 - CAST(outcome = 0 AS INT)) ** 2 + (p1 - CAST(outcome = 1 AS INT)) ** 2 + (p2 - CAST(outcome = 2 AS INT)) ** 2) AS brier,
  -avg(ln(greatest(1e-15, least(1.0, CASE outcome WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)))) AS log_loss,
  avg(CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = outcome AS INT)) AS accuracy, count(*) AS n FROM """
add("forecast_scores", "brier* log_loss* accuracy* n#", [MATCHES], _SCORES + "implied")
add("base_rate_scores", "brier* log_loss* accuracy* n#", [MATCHES, "base AS (SELECT outcome, avg(CAST(outcome = 0 AS INT)) OVER () AS p0, avg(CAST(outcome = 1 AS INT)) OVER () AS p1, avg(CAST(outcome = 2 AS INT)) OVER () AS p2 FROM matches)"], _SCORES + "base")
add("pooled_reliability", "bin# predicted* observed* n#", [MATCHES, "pairs AS (SELECT p0 AS p, outcome = 0 AS y FROM implied UNION ALL SELECT p1, outcome = 1 FROM implied UNION ALL SELECT p2, outcome = 2 FROM implied)"], "SELECT b.bin, avg(p) AS predicted, avg(CAST(y AS INT)) AS observed, count(p) AS n FROM range(10) b(bin) LEFT JOIN pairs ON bin = len(list_filter(range(1, 10), lambda k: k / CAST(10 AS DOUBLE) <= p)) GROUP BY 1")
add("betting_favourite", "bets# profit* roi*", [MATCHES, "picks AS (SELECT *, CASE WHEN o0 <= o1 AND o0 <= o2 THEN 0 WHEN o1 <= o2 THEN 1 ELSE 2 END AS pick FROM odds)", "pnl AS (SELECT CASE WHEN pick = outcome THEN CASE pick WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END - 1 ELSE CAST(-1 AS DOUBLE) END AS p FROM picks)"], "SELECT count(*) AS bets, sum(p) AS profit, avg(p) AS roi FROM pnl")

# --- regimes

HIND = "hind AS (SELECT idx, CASE WHEN value >= hi THEN 2 WHEN value <= lo THEN 0 ELSE 1 END AS label FROM daily, (SELECT quantile_cont(value, 0.33) AS lo, quantile_cont(value, 0.8) AS hi FROM daily))"
REAL = """cuts AS (SELECT idx, value, quantile_cont(value, 0.33) OVER w AS lo, quantile_cont(value, 0.8) OVER w AS hi FROM daily WINDOW w AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reals AS (SELECT idx, CASE WHEN idx < 500 THEN -1 WHEN value >= hi THEN 2 WHEN value <= lo THEN 0 ELSE 1 END AS label FROM cuts)"""
RUNS = """{0}_starts AS (SELECT idx, label, lag(label) OVER (ORDER BY idx) AS b FROM {0} WHERE label >= 0),
{0}_runs AS (SELECT label AS regime, idx AS start, coalesce(lead(idx) OVER (ORDER BY idx), (SELECT max(idx) + 1 FROM {0})) - idx AS length FROM {0}_starts WHERE b IS NULL OR b <> label)"""
add("hindsight_labels", "idx# label#", [DAILY, HIND], "SELECT * FROM hind")
add("realtime_labels", "idx# label#", [DAILY, REAL], "SELECT * FROM reals")
add("regime_transitions", "state# next# p*", [DAILY, HIND, "prs AS (SELECT label AS s, lead(label) OVER (ORDER BY idx) AS t FROM hind)"], "SELECT a.range AS state, b.range AS next, coalesce(count(s) / CAST(nullif((SELECT count(*) FROM prs WHERE s = a.range AND t IS NOT NULL), 0) AS DOUBLE), 0.0) AS p FROM range(3) a CROSS JOIN range(3) b LEFT JOIN prs ON s = a.range AND t = b.range GROUP BY 1, 2")
add("regime_persistence", "persistence*", [DAILY, REAL], "SELECT avg(CAST(label = t AS INT)) AS persistence FROM (SELECT label, lead(label) OVER (ORDER BY idx) AS t FROM reals) WHERE label >= 0 AND t >= 0")
add("regime_runs", "regime# start# length#", [DAILY, REAL, RUNS.format("reals")], "SELECT * FROM reals_runs")
add("regime_disagreement", "days_compared# days_disagreeing# at_turning_points# turning_point_days# rate* rate_near* concentration*", [DAILY, HIND, REAL,
    "turns AS (SELECT idx, label, CAST(coalesce(label <> lag(label) OVER (ORDER BY idx), FALSE) AS INT) AS t FROM hind)", "near AS (SELECT *, max(t) OVER (ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM turns)",
    "s AS (SELECT count(*) AS dc, sum(CAST(n.label <> r.label AS INT)) AS dd, sum(CAST(n.label <> r.label AS INT) * near) AS atp, sum(near) AS tpd FROM near n JOIN reals r USING (idx) WHERE r.label >= 0)"],
    "SELECT dc AS days_compared, dd AS days_disagreeing, atp AS at_turning_points, tpd AS turning_point_days, dd / CAST(dc AS DOUBLE) AS rate, atp / CAST(tpd AS DOUBLE) AS rate_near, (atp / CAST(tpd AS DOUBLE)) / (dd / CAST(dc AS DOUBLE)) AS concentration FROM s")
add("regime_detection_lag", "start# lag#", [DAILY, HIND, REAL, RUNS.format("hind")], "SELECT start, coalesce(min(r.idx - start), 120) AS lag FROM hind_runs LEFT JOIN reals r ON r.label = 2 AND r.idx >= start AND r.idx < start + 120 WHERE regime = 2 AND start >= 500 GROUP BY 1")
add("realised_volatility", "idx# volatility*", [DAILY, "r AS (SELECT idx, ln(value / lag(value) OVER (ORDER BY idx)) AS ret FROM daily)"], "SELECT idx, CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w * sqrt(252) END AS volatility FROM r WINDOW w AS (ORDER BY idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")

# --- overlapping windows

FORWARD = "fwd AS (SELECT idx, x, pow(lead(value, 12) OVER (ORDER BY idx) / value, 1.0) - 1 AS y FROM monthly)"
_OLS = """SELECT {0} sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) END AS se, sxy * sxy / (sxx * syy) AS r2, n
FROM (SELECT {0} count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x - ax) * (x - ax)) AS sxx, sum((y - ay) * (y - ay)) AS syy, sum((x - ax) * (y - ay)) AS sxy FROM (SELECT *, avg(x) OVER ({1}) AS ax, avg(y) OVER ({1}) AS ay FROM ({2})) {3})"""


def _ols(source: str, by: str = "") -> str:
    return _OLS.format(f"{by}," if by else "", f"PARTITION BY {by}" if by else "", source, f"GROUP BY {by}" if by else "")


add("forward_return", "idx# forward*", [MONTHLY, FORWARD], "SELECT idx, y AS forward FROM fwd")
add("ols_overlapping", "slope* intercept* se* r2* n#", [MONTHLY, FORWARD], _ols("SELECT * FROM fwd WHERE y IS NOT NULL"))
add("disjoint_regression", "slope* intercept* se* r2* n#", [MONTHLY, FORWARD], _ols("SELECT * FROM fwd WHERE y IS NOT NULL AND idx >= 3 AND (idx - 3) % 12 = 0"))
add("offset_sweep", '"offset"# slope* se* n#', [MONTHLY, FORWARD], f"SELECT off AS \"offset\", slope, se, n FROM ({_ols('SELECT *, idx % 6 AS off FROM fwd WHERE y IS NOT NULL', 'off')}) WHERE n >= 8")
add("newey_west", "slope* se*", [MONTHLY, FORWARD, "d AS (SELECT idx, x, y FROM fwd WHERE y IS NOT NULL)", "f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM d)",
    "u AS (SELECT idx, y - a - b * x AS s0, (y - a - b * x) * x AS s1 FROM d, f)", "lags AS (SELECT unnest(range(0, 12)) AS g)",
    "m AS (SELECT sum(2 * w * p.s0 * q.s0) AS m00, sum(w * (p.s0 * q.s1 + p.s1 * q.s0)) AS m01, sum(2 * w * p.s1 * q.s1) AS m11 FROM (SELECT g, CASE WHEN g = 0 THEN 0.5 ELSE 1 - g / CAST(12 AS DOUBLE) END AS w FROM lags) JOIN u p ON TRUE JOIN u q ON q.idx = p.idx - g)"],
    "SELECT b AS slope, sqrt(greatest((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / pow(n * sxx - sx * sx, 2), 0)) AS se FROM f, m")

# --- forecasts

_N = "(SELECT count(*) FROM daily)"


def _evaluation(series: str, steps: str, horizon: int, season: int, embargo: int, models: dict[str, str]) -> list[str]:
    """CTEs that score each model's forecast (an expression over h: list of the history) at each origin."""
    unions = " UNION ALL ".join(f"SELECT '{m}' AS model, o, i, act, h, {e} AS f FROM steps" for m, e in models.items())
    return [
        f"origins AS ({steps})",
        f"hist AS (SELECT o, list(value ORDER BY idx) AS h FROM origins JOIN {series} ON idx < greatest(o - {embargo}, 1) GROUP BY 1)",
        f"steps AS (SELECT o, i, h, s.value AS act FROM hist, (SELECT unnest(range(0, {horizon})) AS i) JOIN {series} s ON s.idx = o + i)",
        f"fc AS ({unions})",
        f"per AS (SELECT model, o, avg(abs(f - act)) / any_value(list_avg([abs(h[k] - h[k - {season}]) FOR k IN range({season} + 1, len(h) + 1)])) AS mase, avg(CASE WHEN act <> 0 THEN abs((f - act) / act) END) AS mape, avg(f - act) AS bias FROM fc GROUP BY 1, 2)",
    ]


_DAYS = {
    "seasonal_naive": "h[len(h) - 6 + i % 7]", "drifting_mean": "list_avg(h[greatest(len(h) - 27, 1):len(h)])",
    "seasonal_mean": "list_avg([h[k] FOR k IN range(greatest(1, len(h) - 60), len(h) + 1) IF (k - 1) % 7 = (len(h) + i) % 7][-8:])",
}
_EVAL = "model mase* mape* bias* folds#"
_MEANS = "SELECT model, avg(mase) AS mase, avg(mape) AS mape, avg(bias) AS bias, count(*) AS folds FROM per GROUP BY 1"
add("forecast_evaluation", _EVAL, [DAILY, *_evaluation("daily", f"SELECT unnest(range(120, {_N} - 7 + 1, 7)) AS o", 7, 7, 0, _DAYS)], _MEANS)
add("forecast_evaluation_embargo", _EVAL, [DAILY, *_evaluation("daily", f"SELECT unnest(range(120, {_N} - 7 + 1, 28)) AS o", 7, 7, 5, _DAYS)], _MEANS)
_STEPS = "SELECT CAST(floor(36 + ((SELECT count(*) FROM monthly) - 6 - 36) * k / CAST(9 AS DOUBLE)) AS BIGINT) AS o FROM range(10) r(k)"
_MONTHS = {"random_walk": "h[len(h)]", "drift": "h[len(h)] + (h[len(h)] - h[1]) / CAST(len(h) - 1 AS DOUBLE) * (i + 1)", "trailing_mean": "list_avg(h[greatest(len(h) - 23, 1):len(h)])"}
add("rolling_backtest", _EVAL, [MONTHLY, *_evaluation("monthly", _STEPS, 6, 1, 0, _MONTHS)], _MEANS)

# --- elasticity

PANEL = """sold AS (SELECT p_brand || '/' || p_type AS item, CAST(date_trunc('month', ts) AS DATE) AS month, sum(quantity) AS units, sum(revenue) AS revenue FROM ledger l JOIN part ON l.item = p_partkey WHERE NOT is_return AND quantity > 0 GROUP BY 1, 2),
panel AS (SELECT item, month, units, revenue, revenue / units AS price, ln(units) AS log_units, ln(revenue / units) AS log_price FROM (SELECT *, count(*) OVER (PARTITION BY item) AS months FROM sold WHERE units > 0 AND revenue > 0) WHERE months >= 6)"""
add("product_month_panel", "item month units* revenue* price* log_units* log_price*", [LEDGER, PANEL], "SELECT * FROM panel")
_ESTIMATE = "method elasticity* se* n# items#"
for _name, _label, _x, _y in (
    ("elasticity_pooled", "pooled", "log_price", "log_units"),
    ("elasticity_within", "within product", "log_price - avg(log_price) OVER (PARTITION BY item)", "log_units - avg(log_units) OVER (PARTITION BY item)"),
    ("elasticity_within_month", "within product and month", "log_price - avg(log_price) OVER (PARTITION BY item) - avg(log_price) OVER (PARTITION BY month) + avg(log_price) OVER ()",
     "log_units - avg(log_units) OVER (PARTITION BY item) - avg(log_units) OVER (PARTITION BY month) + avg(log_units) OVER ()"),
):
    add(_name, _ESTIMATE, [LEDGER, PANEL], f"SELECT '{_label}' AS method, slope AS elasticity, se, n, (SELECT count(DISTINCT item) FROM panel) AS items FROM ({_ols(f'SELECT {_x} AS x, {_y} AS y FROM panel')})")
add("elasticity_per_product", "item elasticity* se* months#", [LEDGER, PANEL], f"SELECT item, slope AS elasticity, se, n AS months FROM ({_ols('SELECT item, log_price AS x, log_units AS y FROM panel', 'item')}) WHERE n >= 10")

# --- survival

GAPS = """ords AS (SELECT customer, invoice, min(ts) AS ts, sum(revenue) AS value, count(*) AS items FROM ledger WHERE ts < TIMESTAMP '1997-01-01' GROUP BY 1, 2),
seq AS (SELECT *, lead(ts) OVER w AS nxt, row_number() OVER w AS k FROM ords WINDOW w AS (PARTITION BY customer ORDER BY ts, invoice)),
gaps AS (SELECT customer, greatest((epoch_us(coalesce(nxt, (SELECT max(ts) FROM ords))) - epoch_us(ts)) / CAST(86400000000 AS DOUBLE), 0.5) AS duration, nxt IS NOT NULL AS observed, value AS first_value, items AS first_items FROM seq WHERE k = 1)"""
KM = """dur AS (SELECT duration AS t, count(*) AS k, sum(CAST(observed AS INT)) AS d FROM gaps GROUP BY 1),
risk AS (SELECT t, d, sum(k) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM dur),
km0 AS (SELECT t, n, d, product(1 - d / CAST(n AS DOUBLE)) OVER w AS s, sum(CASE WHEN n > d THEN d / CAST(n * (n - d) AS DOUBLE) ELSE 0 END) OVER w AS g FROM risk WHERE d > 0 WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
km AS (SELECT t AS "time", n AS at_risk, d AS events, s AS survival, greatest(0.0, s - 1.96 * s * sqrt(g)) AS lower, least(1.0, s + 1.96 * s * sqrt(g)) AS upper FROM km0)"""
add("survival_cohort", "customer duration* observed first_value* first_items#", [LEDGER, GAPS], "SELECT * FROM gaps")
add("censoring_rate", "censoring_rate* naive_event_rate*", [LEDGER, GAPS], "SELECT 1 - avg(CAST(observed AS INT)) AS censoring_rate, avg(CAST(observed AS INT)) AS naive_event_rate FROM gaps")
add("kaplan_meier", '"time"* at_risk# events# survival* lower* upper*', [LEDGER, GAPS, KM], "SELECT * FROM km")
SQL["kaplan_meier"] = SQL["kaplan_meier"].replace('AS "time", ', 'AS "time", ', 1)
add("median_survival", "median*", [LEDGER, GAPS, KM], 'SELECT min("time") AS median FROM km WHERE survival <= 0.5 + 1e-12')
add("survival_at", "t* survival*", [LEDGER, GAPS, KM], 'SELECT t, coalesce(arg_max(survival, "time"), 1.0) AS survival FROM (SELECT unnest([0.0, 30.0, 90.0, 365.0]::DOUBLE[]) AS t) LEFT JOIN km ON "time" <= t GROUP BY 1')
add("log_rank", "observed_a# expected_a* variance* chi2*", [LEDGER, GAPS,
    "e AS (SELECT duration AS t, count(*) AS k, sum(CAST(customer % 2 = 0 AS INT)) AS ka, sum(CAST(observed AS INT)) AS d, sum(CAST(observed AND customer % 2 = 0 AS INT)) AS da FROM gaps GROUP BY 1)",
    "r AS (SELECT d, da, sum(k) OVER w AS n, sum(ka) OVER w / CAST(sum(k) OVER w AS DOUBLE) AS s FROM e WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))",
    "z AS (SELECT sum(da) AS o, sum(d * s) AS e, sum(d * s * (1 - s) * (n - d) / (n - 1)) AS v FROM r WHERE n >= 2 AND d > 0)"], "SELECT o AS observed_a, e AS expected_a, v AS variance, (o - e) * (o - e) / v AS chi2 FROM z")
add("concordance", "c_index* pairs#", [LEDGER, GAPS], "SELECT sum(CASE WHEN b.first_items < a.first_items THEN 1.0 WHEN b.first_items = a.first_items THEN 0.5 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS c_index, count(*) AS pairs FROM gaps a JOIN gaps b ON a.observed AND b.duration > a.duration")

# --- target encoding

CATEGORIES = "cats AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS category, CAST(l_returnflag = 'R' AS INT) AS y, CASE WHEN l_orderkey % 4 < 3 THEN 'train' ELSE 'test' END AS split FROM lineitem)"


def _means(rows: str, m: float) -> str:
    return f"means AS (SELECT category, count(*) AS n, (sum(y) + {m} * (SELECT avg(y) FROM {rows})) / CAST(count(*) + {m} AS DOUBLE) AS encoded FROM {rows} GROUP BY 1)"


_TRAIN = "trn AS (SELECT * FROM cats WHERE split = 'train')"
_ENCODED = "id split y# encoded*"
add("category_means", "category n# encoded*", [CATEGORIES, _means("cats", 20)], "SELECT * FROM means")
add("encoding_naive", _ENCODED, [CATEGORIES, _means("cats", 0)], "SELECT id, split, y, encoded FROM cats JOIN means USING (category)")
for _name, _m in (("encoding_train_only", 0), ("encoding_smoothed", 50)):
    add(_name, _ENCODED, [CATEGORIES, _TRAIN, _means("trn", _m)], "SELECT id, split, y, coalesce(encoded, (SELECT avg(y) FROM trn)) AS encoded FROM cats LEFT JOIN means USING (category)")
add("encoding_out_of_fold", _ENCODED, [CATEGORIES, _TRAIN, "pr AS (SELECT avg(y) AS p FROM trn)", "tot AS (SELECT category, count(*) AS n, sum(y) AS s FROM trn GROUP BY 1)", "own AS (SELECT category, id % 5 AS f, count(*) AS n, sum(y) AS s FROM trn GROUP BY 1, 2)"],
    """SELECT id, split, y, (t.s - o.s + 20 * p) / CAST(t.n - o.n + 20 AS DOUBLE) AS encoded FROM trn r JOIN tot t ON r.category = t.category JOIN own o ON o.category = r.category AND o.f = r.id % 5, pr
    UNION ALL SELECT id, split, y, coalesce((s + 20 * p) / CAST(n + 20 AS DOUBLE), p) FROM cats c LEFT JOIN tot t ON c.category = t.category, pr WHERE split = 'test'""")  # fmt: skip
_BUCKET = "CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 20 THEN '5-19' WHEN n < 100 THEN '20-99' ELSE '100+' END AS bucket"
add("cardinality_profile", "bucket categories# rows# share*", [CATEGORIES, "e AS (SELECT category, count(*) AS n FROM cats GROUP BY 1)"], f'SELECT {_BUCKET}, count(*) AS categories, sum(n) AS "rows", sum(n) / CAST((SELECT sum(n) FROM e) AS DOUBLE) AS share FROM e GROUP BY 1')
add("leak_by_rarity", "bucket rows# correlation*", [CATEGORIES, _means("cats", 0)], f'SELECT * FROM (SELECT {_BUCKET}, count(*) AS "rows", corr(encoded, y) AS correlation, stddev_pop(y) AS sd FROM cats JOIN means USING (category) GROUP BY 1) WHERE "rows" >= 30 AND sd > 0')
for _name in ("cardinality_profile", "leak_by_rarity"):
    SQL[_name] = SQL[_name].replace("CAST(rows AS BIGINT) AS rows", 'CAST("rows" AS BIGINT) AS "rows"')

# --- association rules


def _rules(baskets: str = "baskets", name: str = "rules") -> str:
    return f"""{name}_n AS (SELECT count(DISTINCT basket) AS t FROM {baskets}), {name}_c AS (SELECT item, count(*) AS n FROM {baskets} GROUP BY 1 ORDER BY n DESC, item LIMIT 400),
{name}_p AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM {baskets} a JOIN {baskets} b ON a.basket = b.basket AND a.item <> b.item WHERE a.item IN (SELECT item FROM {name}_c) AND b.item IN (SELECT item FROM {name}_c) GROUP BY 1, 2 HAVING count(*) >= 5),
{name} AS (SELECT a AS antecedent, b AS consequent, p.n AS support_count, p.n / CAST(t AS DOUBLE) AS support, p.n / CAST(x.n AS DOUBLE) AS confidence, p.n / CAST(x.n AS DOUBLE) / (y.n / CAST(t AS DOUBLE)) AS lift,
  y.n / CAST(t AS DOUBLE) AS consequent_support, p.n / CAST(t AS DOUBLE) - x.n / CAST(t AS DOUBLE) * (y.n / CAST(t AS DOUBLE)) AS leverage FROM {name}_p p JOIN {name}_c x ON a = x.item JOIN {name}_c y ON b = y.item, {name}_n)"""


add("basket_sizes", "size# baskets#", [BASKETS], "SELECT size, count(DISTINCT basket) AS baskets FROM baskets GROUP BY 1")
add("item_counts", "item n#", [BASKETS], "SELECT item, count(*) AS n FROM baskets GROUP BY 1")
add("pair_counts", "a b n#", ["k AS (SELECT DISTINCT l_orderkey AS basket, CAST(l_partkey AS VARCHAR) AS item FROM lineitem)"], "SELECT x.item AS a, y.item AS b, count(*) AS n FROM k x JOIN k y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2")
add("association_rules", "antecedent consequent support_count# support* confidence* lift* consequent_support* leverage*", [BASKETS, _rules()], "SELECT * FROM rules")
_SPLIT = """lines AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), mid AS (SELECT max(l_orderkey) / CAST(2 AS DOUBLE) AS m FROM lineitem),
early AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY basket) AS size FROM lines, mid WHERE basket <= m) WHERE size > 1), late AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY basket) AS size FROM lines, mid WHERE basket > m) WHERE size > 1)"""
add("rules_holdout", "antecedent consequent lift* later_count# later_lift* held", [_SPLIT, _rules("early"), "best AS (SELECT antecedent, consequent, lift FROM rules ORDER BY lift DESC, antecedent, consequent LIMIT 50)", "lc AS (SELECT item, count(*) AS n FROM late GROUP BY 1)",
    "j AS (SELECT antecedent, consequent, count(*) AS n FROM best JOIN late a ON a.item = antecedent JOIN late b ON b.item = consequent AND a.basket = b.basket GROUP BY 1, 2)"],
    """SELECT b.antecedent, b.consequent, lift, coalesce(j.n, 0) AS later_count, coalesce(j.n, 0) * (SELECT count(DISTINCT basket) FROM late) / CAST(x.n * y.n AS DOUBLE) AS later_lift,
    coalesce(coalesce(j.n, 0) * (SELECT count(DISTINCT basket) FROM late) / CAST(x.n * y.n AS DOUBLE) > 1, FALSE) AS held FROM best b LEFT JOIN j USING (antecedent, consequent) LEFT JOIN lc x ON x.item = b.antecedent LEFT JOIN lc y ON y.item = b.consequent""")  # fmt: skip

# --- pricing

add("policies", "policy exposure* claims# amount* segment nation# balance*", [POLICIES], "SELECT * FROM policies")
_EDGES = [-1000, 0, 2500, 5000, 7500, 10000]
_BAND = "CASE WHEN balance >= -1000 AND balance <= 0 THEN 'bal-999-0' " + " ".join(f"WHEN balance > {a} AND balance <= {b} THEN 'bal{a + 1}-{b}'" for a, b in zip(_EDGES[1:], _EDGES[2:], strict=False)) + " END"
add("pricing_bands", "balance_band nation_band policies# claims#", [POLICIES, "q AS (SELECT quantile_cont(nation, [0.2, 0.4, 0.6, 0.8]) AS c FROM policies)", f"b AS (SELECT {_BAND} AS balance_band, 'nat' || (len(list_filter(c, lambda v: v < nation)) + 1) AS nation_band, claims FROM policies, q WHERE exposure > 0)"],
    "SELECT balance_band, nation_band, count(*) AS policies, sum(claims) AS claims FROM b WHERE balance_band IS NOT NULL GROUP BY 1, 2")
add("frequency_by_segment", "term relativity*", [POLICIES, "r AS (SELECT segment, sum(claims) / sum(exposure) AS rate, row_number() OVER (ORDER BY segment) AS k FROM policies GROUP BY 1)"],
    "SELECT CASE WHEN k = 1 THEN 'intercept' ELSE 'segment=' || segment END AS term, round(CASE WHEN k = 1 THEN rate ELSE rate / (SELECT rate FROM r WHERE k = 1) END, 4) AS relativity FROM r")
add("pricing_lift_table", "decile# policies# exposure_years* predicted* actual* ratio*", [POLICIES, "r AS (SELECT *, row_number() OVER (ORDER BY predicted, id) - 1 AS at_, count(*) OVER () AS n FROM priced)", "c AS (SELECT len(list_filter(range(1, 10), lambda b: n * b // 10 <= at_)) + 1 AS decile, exposure, predicted, actual FROM r)"],
    "SELECT decile, count(*) AS policies, sum(exposure) AS exposure_years, sum(predicted) / sum(exposure) AS predicted, sum(actual) / sum(exposure) AS actual, (sum(actual) / sum(exposure)) / (sum(predicted) / sum(exposure)) AS ratio FROM c GROUP BY 1")
add("poisson_deviance", "deviance*", [POLICIES], "SELECT 2 * avg(CASE WHEN actual > 0 THEN actual * ln(actual / predicted) ELSE 0 END - (actual - predicted)) AS deviance FROM priced")
add("credible_bands", "band# policies# exposure_years* claims* predicted_claims* share_claiming* observed_rate* predicted_rate* credible", [POLICIES],
    "SELECT len(list_filter([0.05, 0.15, 0.35, 0.6, 0.85]::DOUBLE[], lambda e: e < exposure)) AS band, count(*) AS policies, sum(exposure) AS exposure_years, sum(actual) AS claims, sum(predicted) AS predicted_claims, avg(CAST(actual > 0 AS INT)) AS share_claiming, sum(actual) / sum(exposure) AS observed_rate, sum(predicted) / sum(exposure) AS predicted_rate, sum(exposure) >= 100 AS credible FROM priced GROUP BY 1")
add("large_loss_cap", "cap* total*", [POLICIES, "q AS (SELECT quantile_cont(amount, 0.995) AS c FROM policies WHERE amount > 0)"], "SELECT max(least(amount, c)) AS cap, sum(least(amount, c)) AS total FROM policies, q")

# --- recommenders, clusters, regularisation

add("interactions", "role rows# users# items#", [INTERACTIONS], 'SELECT role, count(*) AS "rows", count(DISTINCT "user") AS users, count(DISTINCT item) AS items FROM sides GROUP BY 1')
SQL["interactions"] = SQL["interactions"].replace("CAST(rows AS BIGINT) AS rows", 'CAST("rows" AS BIGINT) AS "rows"')
POPULAR = """pop AS (SELECT item, count(*) AS c FROM train GROUP BY 1),
recs AS (SELECT "user", item, rank FROM (SELECT u."user", p.item, row_number() OVER (PARTITION BY u."user" ORDER BY c DESC, p.item) - 1 AS rank FROM (SELECT DISTINCT "user" FROM test) u CROSS JOIN pop p LEFT JOIN seen s ON s."user" = u."user" AND s.item = p.item WHERE s.item IS NULL) WHERE rank < 10)"""
add("recommend_popularity", '"user" item rank#', [INTERACTIONS, POPULAR], "SELECT * FROM recs")
SIMILAR = """cnt AS (SELECT item, count(*) AS c FROM seen GROUP BY 1), both_ AS (SELECT a.item AS item, b.item AS other, count(*) AS n FROM seen a JOIN seen b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
sim AS (SELECT b.item, other, n / sqrt(x.c * y.c) AS similarity FROM both_ b JOIN cnt x ON x.item = b.item JOIN cnt y ON y.item = other)"""
add("item_similarity", "item other similarity*", [INTERACTIONS, SIMILAR], "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY item ORDER BY similarity DESC) AS r FROM sim) WHERE r <= 10")
KNN = """near AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY item ORDER BY similarity DESC) AS r FROM sim) WHERE r <= 50),
sc AS (SELECT s."user", n.other AS item, round(sum(similarity), 9) AS score FROM seen s JOIN near n ON n.item = s.item WHERE s."user" IN (SELECT "user" FROM test) GROUP BY 1, 2),
recs AS (SELECT "user", item, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY c."user" ORDER BY score DESC, c.item) - 1 AS rank FROM sc c LEFT JOIN seen s ON s."user" = c."user" AND s.item = c.item WHERE s.item IS NULL) WHERE rank < 10)"""
RANKING = """rel AS (SELECT DISTINCT "user", item, 1 AS hit FROM test), sizes AS (SELECT "user", count(*) AS relevant FROM rel GROUP BY 1), freq AS (SELECT item, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS f FROM train GROUP BY 1),
users_ AS (SELECT r."user", sum(coalesce(hit, 0)) AS hits, any_value(relevant) AS relevant, count(*) AS shown, sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 2) ELSE 0 END) AS gain, avg(-log2(greatest(coalesce(f, 0), 1e-12))) AS novelty
  FROM recs r JOIN sizes z ON z."user" = r."user" LEFT JOIN rel ON rel."user" = r."user" AND rel.item = r.item LEFT JOIN freq ON freq.item = r.item GROUP BY 1)"""
_SCORE = 'SELECT avg(hits / CAST(10 AS DOUBLE)) AS precision, avg(hits / CAST(relevant AS DOUBLE)) AS recall, avg(gain / list_sum([1 / log2(k + 2) FOR k IN range(least(relevant, shown))])) AS ndcg, (SELECT count(DISTINCT item) FROM recs WHERE "user" IN (SELECT "user" FROM sizes)) / CAST((SELECT count(DISTINCT item) FROM train) AS DOUBLE) AS coverage, avg(novelty) AS novelty, count(*) AS users FROM users_'
add("ranking_popularity", "precision* recall* ndcg* coverage* novelty* users#", [INTERACTIONS, POPULAR, RANKING], _SCORE)
add("ranking_item_knn", "precision* recall* ndcg* coverage* novelty* users#", [INTERACTIONS, SIMILAR, KNN, RANKING], _SCORE)
add("adjusted_rand", "ari*", ["c AS (SELECT label AS a, vec_id % 5 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2)", "s AS (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS s, sum(n) * (sum(n) - 1) / CAST(2 AS DOUBLE) AS t FROM c)", "x AS (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a))", "y AS (SELECT sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))"],
    "SELECT (s.s - x.s * y.s / t) / ((x.s + y.s) / 2 - x.s * y.s / t) AS ari FROM s, x, y")
add("shuffled_columns", "id before* after*", [
    "o AS (SELECT vec_id AS id, embedding AS x, row_number() OVER (ORDER BY CAST('0x' || substr(md5(vec_id || '/0'), 1, 12) AS BIGINT) % 2147483647, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)",
    "e AS (SELECT id, i, n, unnest(range(0, 64)) AS k, unnest(x) AS v FROM o)", "m AS (SELECT (i - k * n // 64 + n) % n AS i, k, v FROM e)",
    "b AS (SELECT i, sum((k + 1) * CAST(v AS DOUBLE)) AS before FROM e GROUP BY 1)", "a AS (SELECT i, sum((k + 1) * CAST(v AS DOUBLE)) AS after FROM m GROUP BY 1)",
], "SELECT id, before, after FROM o JOIN b USING (i) JOIN a USING (i)")
_DERIVED = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax", "price": "l_extendedprice / l_quantity", "net": "l_extendedprice * (1 - l_discount)", "tax": "l_extendedprice * l_tax"}
add("correlated_pairs", "a b r*", [], " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({_DERIVED[a]}, {_DERIVED[b]}) AS r FROM lineitem" for k, a in enumerate(_DERIVED) for b in list(_DERIVED)[k + 1 :]))
