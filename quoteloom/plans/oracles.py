"""DuckDB SQL of the named queries, written apart from the DataFrame code."""

from __future__ import annotations

from ..sources.binding import SLOTS

_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_SLOTS = "slots(slot, family, market_type, participant, line_c, outcome, base) AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in SLOTS) + ")"
_Q = f"""{_SLOTS},
q AS (SELECT l_partkey AS event, CAST(slot AS INTEGER) AS slot, l_suppkey AS book, max(round(CAST(base AS DOUBLE) + l_discount * 4 + l_tax * 2, 2)) AS odds, max(epoch_ms(l_shipdate)) AS observed_ms,
  lpad(CAST(l_partkey AS VARCHAR), 9, '0') || ':' || lpad(CAST(slot AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS leg_id
  FROM lineitem JOIN slots ON slot = l_orderkey % 12 GROUP BY l_partkey, slot, l_suppkey),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY event, slot ORDER BY odds DESC, book) AS r FROM q) WHERE r = 1)"""
_OK = "(x.family = y.family OR (least(x.family, y.family), greatest(x.family, y.family)) IN (('MATCH_TOTAL', 'TEAM_TOTAL'), ('ASIAN_TOTAL', 'MATCH_TOTAL'), ('ASIAN_TOTAL', 'TEAM_TOTAL'), ('DOUBLE_CHANCE', 'MATCH_RESULT'), ('BTTS', 'MATCH_TOTAL')))"
_P = f"""{_Q},
ok AS (SELECT CAST(x.slot AS INTEGER) AS slot_a, CAST(y.slot AS INTEGER) AS slot_b, x.family AS fa, y.family AS fb,
  (x.family = y.family AND x.participant IS NOT DISTINCT FROM y.participant AND x.line_c IS NOT DISTINCT FROM y.line_c
   AND (x.outcome, y.outcome) IN (('OVER', 'UNDER'), ('UNDER', 'OVER'), ('BTTS_YES', 'BTTS_NO'), ('BTTS_NO', 'BTTS_YES'), ('HOME', 'AWAY'), ('AWAY', 'HOME'))) AS complement
  FROM slots x JOIN slots y ON x.slot < y.slot WHERE {_OK}),
p AS (SELECT a.event, slot_a, slot_b, a.odds AS odds_a, b.odds AS odds_b, a.book AS book_a, b.book AS book_b, a.observed_ms AS ms_a, b.observed_ms AS ms_b, complement, fa, fb
  FROM ok JOIN best a ON a.slot = slot_a JOIN best b ON b.event = a.event AND b.slot = slot_b)"""
_T = f"""{_P},
t AS (SELECT p.*, o.slot_b AS slot_c, c.odds AS odds_c, o.fb AS fc FROM p JOIN ok o ON o.slot_a = p.slot_b JOIN ok o2 ON o2.slot_a = p.slot_a AND o2.slot_b = o.slot_b JOIN best c ON c.event = p.event AND c.slot = o.slot_b)"""
# A score's result for a selection, from the words of the rules: side by side with line neighbours for quarter lines.
_RESULT = """CASE WHEN family IN ('MATCH_TOTAL', 'ASIAN_TOTAL', 'TEAM_TOTAL') THEN
  (CASE WHEN outcome = 'OVER' THEN 1 ELSE -1 END) * (CASE WHEN line_c % 50 = 25 THEN sign(g * 100 - line_c + 25) + sign(g * 100 - line_c - 25) ELSE 2 * sign(g * 100 - line_c) END)
  WHEN family = 'ASIAN_HANDICAP' THEN CASE WHEN abs(line_c) % 50 = 25 THEN sign(g * 100 + line_c + 25) + sign(g * 100 + line_c - 25) ELSE 2 * sign(g * 100 + line_c) END
  WHEN family = 'EXACT_SCORE' THEN CASE WHEN NOT regexp_full_match(outcome, '[0-9]+-[0-9]+') THEN NULL WHEN outcome = home || '-' || away THEN 2 ELSE -2 END
  WHEN outcome = 'HOME' THEN CASE WHEN home > away THEN 2 ELSE -2 END WHEN outcome = 'DRAW' THEN CASE WHEN home = away THEN 2 ELSE -2 END
  WHEN outcome = 'AWAY' THEN CASE WHEN home < away THEN 2 ELSE -2 END WHEN outcome = 'HOME_OR_DRAW' THEN CASE WHEN home >= away THEN 2 ELSE -2 END
  WHEN outcome = 'BTTS_YES' THEN CASE WHEN least(home, away) > 0 THEN 2 ELSE -2 END ELSE CASE WHEN least(home, away) = 0 THEN 2 ELSE -2 END END"""
_GOALS = "CASE family WHEN 'TEAM_TOTAL' THEN CASE participant WHEN 'HOME' THEN home ELSE away END WHEN 'ASIAN_HANDICAP' THEN CASE participant WHEN 'HOME' THEN home - away ELSE away - home END ELSE home + away END"


def _settled(slots: str = _SLOTS) -> str:
    return f"""{slots}, m AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS home, CAST(o_custkey % 4 AS INTEGER) AS away, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'POSTPONED' ELSE 'SCHEDULED' END AS status FROM orders),
g AS (SELECT *, {_GOALS} AS g FROM m, slots), r AS (SELECT CAST(slot AS INTEGER) AS slot, home, away, status, base, family, CAST({_RESULT} AS INTEGER) AS result FROM g)"""


def _count(families: str = "", slots: str = _SLOTS) -> str:
    return f"WITH {_settled(slots)} SELECT slot, home, away, max(result) AS result, count(*) AS matches FROM r {families} GROUP BY ALL"


_STATES = f"""{_P}, grid AS (SELECT * FROM range(6) h(home), range(6) a(away)), sg AS (SELECT *, {_GOALS} AS g FROM grid, slots),
sr AS (SELECT slot, home, away, family || '|' || coalesce(participant, '-') AS metric, CASE WHEN line_c IS NULL THEN 1 ELSE CAST(ceil(line_c / 100.0) AS INTEGER) END AS bound, CAST({_RESULT} AS INTEGER) AS result FROM sg),
st AS (SELECT CAST(x.slot AS INTEGER) AS slot_a, CAST(y.slot AS INTEGER) AS slot_b, x.home, x.away, x.result AS ra, y.result AS rb, x.metric = y.metric AS same FROM sr x JOIN sr y ON x.home = y.home AND x.away = y.away AND x.slot < y.slot
  WHERE greatest(x.home, x.away) <= greatest(2, greatest(x.bound, y.bound) + 1)),
v AS (SELECT slot_a, slot_b, count(*) FILTER (ra = -2 AND rb = -2) AS n_lost, count(*) FILTER (ra > 0 AND rb > 0 AND same) AS n_overlap,
  count(*) FILTER (ra <= 0 AND rb <= 0 AND NOT (ra = -2 AND rb = -2)) AS n_gap, count(*) AS n_states, count(DISTINCT (ra, rb)) AS n_classes FROM st GROUP BY ALL),
vv AS (SELECT *, CASE WHEN n_lost + n_overlap + n_gap = 0 THEN 'COVERED' ELSE concat_ws('+', CASE WHEN n_lost > 0 THEN 'BOTH_LOSS_STATE' END, CASE WHEN n_overlap > 0 THEN 'NON_EXCLUSIVE' END, CASE WHEN n_gap > 0 THEN 'NON_EXHAUSTIVE' END) END AS verdict FROM v)"""
_MULT = "CASE {r} WHEN 2 THEN {o} WHEN 1 THEN ({o} + 1) / 2 WHEN 0 THEN 1.0 WHEN -1 THEN 0.5 ELSE 0.0 END"


def _maximin(covered: str) -> str:
    return f"""{_STATES}, cls AS (SELECT DISTINCT slot_a, slot_b, ra, rb FROM st),
mx AS (SELECT p.event, p.slot_a, p.slot_b, {_MULT.format(r='ra', o='odds_a')} AS x, {_MULT.format(r='rb', o='odds_b')} AS y FROM p JOIN vv USING (slot_a, slot_b) JOIN cls USING (slot_a, slot_b) {covered}),
sh AS (SELECT DISTINCT event, slot_a, slot_b, unnest([0.0, 1.0]) AS s FROM mx UNION SELECT i.event, i.slot_a, i.slot_b, (j.y - i.y) / ((i.x - i.y) - (j.x - j.y)) FROM mx i JOIN mx j USING (event, slot_a, slot_b) WHERE (i.x - i.y) <> (j.x - j.y)),
wr AS (SELECT event, slot_a, slot_b, s, min(x * s + y * (1 - s)) AS w FROM sh JOIN mx USING (event, slot_a, slot_b) WHERE s BETWEEN 0 AND 1 GROUP BY ALL),
bw AS (SELECT event, slot_a, slot_b, max(w) AS best_return FROM wr GROUP BY ALL)"""


_SCAN = f"""{_maximin('')}, sc AS (SELECT p.*, CASE WHEN book_a = book_b OR (complement AND 1 / odds_a + 1 / odds_b >= 1) THEN 'PRUNED' WHEN verdict <> 'COVERED' THEN 'REJECTED'
  WHEN round(best_return, 9) > 1 + 1e-9 THEN 'ARB' ELSE 'NO_ARB' END AS status FROM p JOIN vv USING (slot_a, slot_b) JOIN bw USING (event, slot_a, slot_b))"""
_RUNS = "r AS (SELECT event_id AS run_id, user_id % 10 AS source, epoch_us(ts) // 1000 AS started_ms, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS latency_ms, CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, user_id FROM events)"
_SER = "s AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, round(1 + value / 100, 6) AS price FROM events)"
_EPI = f"{_SER}, n AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w > 259200000 THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY at_ms, seq)), e AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id, event_type ORDER BY at_ms, seq) AS BIGINT) AS episode FROM n)"
_HAND = "slots(slot, family, market_type, participant, line_c, outcome, base) AS (VALUES (20, 'ASIAN_HANDICAP', '', 'HOME', -100, 'HOME', 1.9), (21, 'ASIAN_HANDICAP', '', 'HOME', 25, 'HOME', 1.9), (22, 'ASIAN_HANDICAP', '', 'AWAY', -75, 'AWAY', 1.9), (23, 'ASIAN_HANDICAP', '', 'AWAY', 150, 'AWAY', 1.9))"
_EXACT = "slots(slot, family, market_type, participant, line_c, outcome, base) AS (VALUES (30, 'EXACT_SCORE', '', NULL, CAST(NULL AS INTEGER), '2-1', 9.0), (31, 'EXACT_SCORE', '', NULL, NULL, '0-0', 8.0), (32, 'EXACT_SCORE', '', NULL, NULL, 'x-1', 8.0))"
_PROV = "pe AS (SELECT o_orderkey AS id, o_orderkey % 2 AS provider, n_name AS home, c_mktsegment AS away, o_orderpriority AS competition, epoch_ms(o_orderdate) AS start_ms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_WIRE = """w AS (SELECT o_orderkey AS k, unnest([
  {'key': 'totals', 'name': 'Over 2.5', 'price': 1 + (o_orderkey % 4) / 2.0, 'line': CASE WHEN o_orderkey % 5 = 0 THEN '2.5' ELSE '2.5' END, 'own': o_orderkey % 7 <> 0},
  {'key': 'totals', 'name': 'Under', 'price': 1.9, 'line': CASE WHEN o_orderkey % 5 = 0 THEN '2.5' END, 'own': o_orderkey % 7 <> 0},
  {'key': CASE WHEN o_orderkey % 2 = 0 THEN 'h2h' ELSE 'specials' END, 'name': 'Home', 'price': 2.1, 'line': NULL, 'own': false}]) AS o FROM orders),
x AS (SELECT k, o.key AS key, o.name AS name, o.price AS price, o.line AS line, CASE WHEN o.key = 'specials' THEN 'unknown_market' WHEN NOT (o.own OR k % 3 <> 0) THEN 'missing_timestamp' WHEN o.price <= 1 THEN 'bad_price'
  WHEN o.key = 'totals' AND o.line IS NULL THEN 'missing_line' WHEN k % 50 = 0 THEN 'same_team' END AS skip FROM w)"""

SQL = {
    "best_price": f"WITH {_Q} SELECT event, slot, book, odds, observed_ms, leg_id FROM best",
    "candidate_pairs": f"WITH {_P} SELECT event, slot_a, slot_b, odds_a, odds_b FROM p",
    "candidate_triples": f"WITH {_T} SELECT event, slot_a, slot_b, slot_c, round(1 / odds_a + 1 / odds_b + 1 / odds_c, 6) AS reciprocal FROM t",
    "candidate_cap": f"WITH {_P} SELECT event, slot_a, slot_b, row_number() OVER (ORDER BY event, slot_a, slot_b) AS rank FROM p QUALIFY rank <= 20000",
    "prune_verdicts": f"""WITH {_P} SELECT event, slot_a, slot_b, concat_ws('+', CASE WHEN complement AND 1 / odds_a + 1 / odds_b >= 1 THEN 'PRICE_PREFILTER' END, CASE WHEN book_a = book_b THEN 'SAME_BOOKMAKER' END,
        CASE WHEN 1704067200000 - least(ms_a, ms_b) > 157680000000 THEN 'STALE_ODDS' END) AS reasons FROM p""",
    "structure_class": f"""WITH {_T}, k AS (SELECT 2 AS legs, [fa, fb] AS f, complement FROM p UNION ALL SELECT 3, [fa, fb, fc], false FROM t)
        SELECT legs, CASE WHEN len(list_distinct(f)) > 1 THEN CASE WHEN list_contains(f, 'TEAM_TOTAL') AND list_contains(f, 'MATCH_TOTAL') THEN 'TEAM_TOTAL_MATCH_TOTAL' WHEN legs = 3 THEN 'MULTI_LEG_PARTITION' ELSE 'GENERIC' END
          WHEN f[1] = 'MATCH_TOTAL' THEN CASE WHEN complement THEN 'SAME_MARKET_COMPLEMENT' ELSE 'COMPLEMENTARY_TOTALS' END WHEN f[1] = 'ASIAN_TOTAL' THEN 'ASIAN_LINE'
          WHEN f[1] IN ('MATCH_RESULT', 'DOUBLE_CHANCE') THEN 'PARTITION' WHEN legs = 3 THEN 'MULTI_LEG_PARTITION' ELSE 'GENERIC' END AS structure, count(*) AS candidates FROM k GROUP BY ALL""",
    "complement_prefilter": f"WITH {_P} SELECT event, slot_a, slot_b, round(1 / odds_a + 1 / odds_b, 6) AS reciprocal FROM p WHERE complement AND 1 / odds_a + 1 / odds_b < 1",
    "settle_totals": _count("WHERE family IN ('MATCH_TOTAL', 'TEAM_TOTAL')"),
    "settle_quarter": _count("WHERE family = 'ASIAN_TOTAL'"),
    "settle_result": _count("WHERE family IN ('MATCH_RESULT', 'DOUBLE_CHANCE')"),
    "settle_btts": _count("WHERE family = 'BTTS'"),
    "settle_handicap": _count("", _HAND),
    "settle_exact": _count("", _EXACT),
    "settle_void": f"WITH {_settled()} SELECT slot, status, CASE status WHEN 'POSTPONED' THEN 'VOID' WHEN 'FINISHED' THEN ['FULL_LOSS', 'HALF_LOSS', 'PUSH', 'HALF_WIN', 'FULL_WIN'][result + 3] END AS settled, count(*) AS matches FROM r GROUP BY ALL",
    "payout": f"WITH {_settled()} SELECT slot, round(sum({_MULT.format(r='result', o='CAST(base AS DOUBLE)')}), 4) AS returned, count(*) AS matches FROM r WHERE status = 'FINISHED' GROUP BY slot",
    "state_vectors": f"WITH {_STATES} SELECT slot_a, slot_b, n_states, n_classes FROM v",
    "coverage_verdicts": f"WITH {_STATES} SELECT slot_a, slot_b, verdict, n_lost, n_overlap, n_gap, count(*) AS candidates FROM p JOIN vv USING (slot_a, slot_b) GROUP BY ALL",
    "payoff_matrix": f"WITH {_maximin('WHERE verdict = ' + chr(39) + 'COVERED' + chr(39))} SELECT event, slot_a, slot_b, count(*) AS states, round(max(greatest(x, y)), 6) AS largest FROM mx GROUP BY ALL",
    "classic_two_way": f"WITH {_P} SELECT event, slot_a, slot_b, round(100 / odds_a / (1 / odds_a + 1 / odds_b), 6) AS stake_a, round(100 / odds_b / (1 / odds_a + 1 / odds_b), 6) AS stake_b, round(1 / (1 / odds_a + 1 / odds_b) - 1, 6) AS roi FROM p WHERE complement",
    "classic_three_way": f"WITH {_T}, u AS (SELECT *, 1 / odds_a + 1 / odds_b + 1 / odds_c AS total FROM t WHERE slot_a = 5 AND slot_b = 6 AND slot_c = 7) SELECT event, round(100 / odds_a / total, 6) AS stake_a, round(100 / odds_b / total, 6) AS stake_b, round(100 / odds_c / total, 6) AS stake_c, round(1 / total - 1, 6) AS roi FROM u",
    "maximin_two_leg": f"WITH {_maximin('WHERE verdict = ' + chr(39) + 'COVERED' + chr(39))} SELECT event, slot_a, slot_b, round(best_return, 6) AS best_return FROM bw",
    "scan_status": f"WITH {_SCAN} SELECT event, slot_a, slot_b, status FROM sc",
    "validation_status": f"""WITH {_SCAN} SELECT event, slot_a, slot_b, CASE WHEN status <> 'ARB' THEN 'REJECTED' WHEN event % 11 = 0 OR (event % 3 <> 0 AND event % 13 = 0) THEN 'INVALIDATED' WHEN book_a % 7 = 0 OR book_b % 7 = 0 THEN 'THEORETICAL_ARB'
        WHEN 1704067200000 - least(ms_a, ms_b) > 189216000000 THEN 'STALE' WHEN abs(ms_a - ms_b) > 94608000000 THEN 'REJECTED' WHEN event % 3 <> 0 THEN 'VERIFIED_ARB' ELSE 'FRESH_ARB' END AS status FROM sc""",
    "freshness_bands": f"WITH {_RUNS} SELECT source, CASE WHEN greatest(0, 20000 - latency_ms) < 5000 THEN 'FRESH' WHEN greatest(0, 20000 - latency_ms) < 15000 THEN 'AGING' ELSE 'STALE' END AS band, count(*) AS runs FROM r GROUP BY ALL",
    "recheck_compare": f"WITH {_Q}, n AS (SELECT event, slot, max(odds) AS now FROM q WHERE book % 2 = 0 GROUP BY ALL) SELECT CASE WHEN now IS NULL THEN 'MISSING' WHEN abs(now - odds) / odds > 0.001 THEN 'CHANGED' ELSE 'OK' END AS outcome, count(*) AS selections FROM best LEFT JOIN n USING (event, slot) GROUP BY ALL",
    "cross_source_spread": f"WITH {_P} SELECT slot_a, slot_b, max(abs(ms_a - ms_b)) AS spread_ms, count(*) FILTER (abs(ms_a - ms_b) <= 60000) AS within FROM p GROUP BY ALL",
    "rule_asof": f"""WITH {_RUNS}, b AS (SELECT s AS source, v AS version, CASE WHEN v > 0 THEN 1704067200000 + v * 259200000 + s * 1000 END AS f, CASE WHEN v % 2 = 0 THEN 1704067200000 + (v + 2) * 259200000 END AS u FROM range(9) x(s), range(6) y(v)),
        j AS (SELECT run_id, r.source, started_ms, CAST(version AS INTEGER) AS version, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(f, 0) DESC, version DESC) AS n FROM r LEFT JOIN b ON b.source = r.source AND (f IS NULL OR f <= started_ms) AND (u IS NULL OR started_ms < u))
        SELECT run_id, source, started_ms, version FROM j WHERE n = 1""",
    "price_changes": f"WITH {_SER}, l AS (SELECT *, lag(price) OVER (PARTITION BY user_id, event_type ORDER BY at_ms, seq) AS before FROM s) SELECT * FROM l WHERE before IS NULL OR before <> price",
    "odds_history": f"WITH {_SER} SELECT * FROM s WHERE event_type = 'purchase' AND at_ms BETWEEN 1704067200000 AND 1704672000000 ORDER BY at_ms, seq LIMIT 100",
    "leg_movement": f"WITH {_SER}, g AS (SELECT user_id, event_type, arg_min(price, at_ms) AS first, arg_max(price, at_ms) AS last, min(price) AS low, max(price) AS high, count(*) AS points FROM s GROUP BY ALL) SELECT *, round(last - first, 6) AS delta, round((last - first) / first, 6) AS share FROM g",
    "episodes": f"WITH {_EPI} SELECT user_id, event_type, episode, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS detected, max(at_ms) - min(at_ms) AS duration_ms FROM e GROUP BY ALL",
    "episode_reconstruction": f"WITH {_EPI}, g AS (SELECT user_id, event_type, episode, arg_min(price, at_ms) AS opened, arg_max(price, at_ms) AS closed FROM e GROUP BY ALL) SELECT *, round(closed - opened, 6) AS delta, round((closed - opened) / opened, 6) AS share FROM g",
    "episode_sweep": f"WITH {_SER}, k AS (SELECT user_id, event_type, max(at_ms) AS last_ms, count(*) % 3 <> 0 AS open, bool_or(price > 1.15) AS seen FROM s GROUP BY ALL) SELECT user_id, event_type, CASE WHEN NOT seen AND open AND last_ms < 1706659200000 THEN 'disappeared' WHEN seen AND NOT open THEN 'restored' ELSE 'unchanged' END AS change FROM k",
    "source_latency": f"WITH {_RUNS} SELECT source, count(*) AS runs, round(avg(latency_ms), 6) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, max(started_ms) AS last_run_ms, arg_max(latency_ms, started_ms) AS last_ms FROM r GROUP BY source",
    "source_reliability": f"""WITH {_RUNS}, g AS (SELECT source, count(*) AS runs, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'DOWN') AS down,
        list_sort(list(latency_ms)) AS l, arg_max(status, started_ms) AS last_status, arg_max(latency_ms, started_ms) AS last_ms FROM r GROUP BY source)
        SELECT x.range AS source, coalesce(runs, 0) AS runs, coalesce(healthy, 0) AS healthy, coalesce(degraded, 0) AS degraded, coalesce(down, 0) AS down, round(healthy / runs, 6) AS success_rate,
          l[CAST(ceil(0.5 * runs) AS INTEGER)] AS p50_ms, l[CAST(ceil(0.95 * runs) AS INTEGER)] AS p95_ms, last_status, last_ms FROM range(12) x LEFT JOIN g ON g.source = x.range""",
    "false_positive": f"WITH {_RUNS}, k AS (SELECT user_id, arg_max(status, (started_ms, run_id)) AS status FROM r GROUP BY user_id) SELECT count(*) AS episodes, count(*) FILTER (status = 'HEALTHY') AS verified, count(*) FILTER (status <> 'HEALTHY') AS false_positives, round(count(*) FILTER (status <> 'HEALTHY') / count(*), 6) AS rate FROM k",
    "latest_per_key": f"WITH {_SER} SELECT user_id, event_type, at_ms, seq, price FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY at_ms DESC, seq DESC) = 1",
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (100000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51",
    "event_filters": f"WITH {_PROV} SELECT id, home, away, competition FROM pe WHERE competition ILIKE '%urgent%' AND home ILIKE '%an%' AND start_ms >= 788918400000",
    "admin_counts": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "scanner_summary": f"WITH {_RUNS} SELECT arg_max(status, (started_ms, run_id)) AS status, count(*) FILTER (latency_ms > 30000) AS slow, max(started_ms) AS last_ms FROM r",
    "retention_report": f"WITH {_RUNS}, e AS (SELECT count(*) AS eligible FROM r WHERE started_ms < 1704067200000 + 15 * 86400000) SELECT eligible, CAST(ceil(least(eligible, 20000) / 1000) AS BIGINT) AS batches, least(eligible, 20000) AS taken, eligible > 20000 AS more FROM e",
    # Without hysteresis and repeats a source fires when it turns worse than what was told since it was last healthy, and resolves when it turns healthy.
    "alert_fsm": f"""WITH {_RUNS}, a AS (SELECT source, run_id, started_ms, CASE status WHEN 'DOWN' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END AS level FROM r),
        b AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY started_ms, run_id) AS grp, lag(level) OVER (PARTITION BY source ORDER BY started_ms, run_id) AS prev FROM a),
        c AS (SELECT *, max(level) OVER (PARTITION BY source, grp ORDER BY started_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told FROM b)
        SELECT source, run_id, CASE WHEN level > 0 THEN 'FIRING' ELSE 'RESOLVED' END AS kind, level AS severity FROM c WHERE (level > 0 AND level > coalesce(told, 0)) OR (level = 0 AND prev > 0)""",
    "health_eval": f"WITH {_RUNS} SELECT source, CASE status WHEN 'DEGRADED' THEN 'degraded' WHEN 'DOWN' THEN 'down' ELSE CASE WHEN latency_ms >= 15000 THEN 'stale' ELSE 'ok' END END AS health, count(*) AS runs FROM r GROUP BY ALL",
    "throttled_audit": f"WITH {_RUNS}, l AS (SELECT *, lag(started_ms) OVER (PARTITION BY source, status ORDER BY started_ms, run_id) AS p FROM r) SELECT source, status, count(*) AS kept FROM l WHERE p IS NULL OR started_ms - p >= 60000 GROUP BY ALL",
    "market_fold": f"WITH {_Q} SELECT leg_id, first_value(leg_id) OVER (PARTITION BY event, slot ORDER BY observed_ms, leg_id) AS winner, count(*) OVER (PARTITION BY event, slot) AS members, leg_id = winner AS survives FROM q",
    "market_reconcile_remap": f"WITH {_Q}, f AS (SELECT odds, first_value(leg_id) OVER (PARTITION BY event, slot ORDER BY observed_ms, leg_id) AS market FROM q) SELECT market, count(*) AS selections, max(odds) AS best FROM f GROUP BY market",
    "event_match": f"""WITH {_PROV}, j AS (SELECT p.id, q.id AS stored_id, round(0.5 + CASE WHEN abs(p.start_ms - q.start_ms) <= 7200000 THEN 0.3 ELSE 0.0 END + CASE WHEN p.competition IS NULL OR q.competition IS NULL THEN 0.0 WHEN p.competition = q.competition THEN 0.2 ELSE -0.2 END, 3) AS score
        FROM pe p JOIN pe q ON p.provider = 1 AND q.provider = 0 AND p.home = q.home AND p.away = q.away
        AND q.start_ms // 14400000 IN (p.start_ms // 14400000, p.start_ms // 14400000 + CASE WHEN p.start_ms % 14400000 * 2 < 14400000 THEN -1 ELSE 1 END)),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, stored_id) AS n FROM j) SELECT id, stored_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'confirmed' ELSE 'uncertain' END AS class FROM k WHERE n = 1""",
    "event_match_all": f"""WITH {_PROV}, j AS (SELECT p.id, q.id AS stored_id, CASE WHEN q.id IS NULL THEN 0.0 ELSE round(0.5 + CASE WHEN abs(p.start_ms - q.start_ms) <= 7200000 THEN 0.3 ELSE 0.0 END + CASE WHEN p.competition IS NULL OR q.competition IS NULL THEN 0.0 WHEN p.competition = q.competition THEN 0.2 ELSE -0.2 END, 3) END AS score
        FROM pe p LEFT JOIN pe q ON q.provider = 0 AND p.home = q.home AND p.away = q.away WHERE p.provider = 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, stored_id) AS n FROM j) SELECT id, stored_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'confirmed' WHEN stored_id IS NULL THEN 'none' ELSE 'uncertain' END AS class FROM k WHERE n = 1""",
    "dictionary_resolve": """WITH d(key, canonical) AS (VALUES ('france', 'FRANCE'), ('united states', 'UNITED STATES'), ('germany', 'DEUTSCHLAND'), ('brazil', 'BRASIL'), ('japan', 'JAPAN'))
        SELECT n_name, coalesce(canonical, n_name) AS canonical, CASE WHEN canonical IS NULL THEN 'new' WHEN lower(canonical) = key THEN 'direct' ELSE 'alias' END AS kind
        FROM nation LEFT JOIN d ON trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) = key""",
    "label_classify": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'TEAM_TOTAL' WHEN 1 THEN 'MATCH_RESULT' ELSE 'CARDS' END AS family FROM part""",
    "line_mode": """WITH c AS (SELECT l_partkey, l_quantity, count(*) AS n, min((l_orderkey, l_linenumber)) AS f FROM lineitem GROUP BY ALL) SELECT l_partkey, l_quantity, n FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, f) = 1""",
    "wire_flatten": f"WITH {_WIRE} SELECT key, coalesce(skip, 'valid') AS skip, count(*) AS outcomes FROM x GROUP BY ALL",
    "canonical_validate": f"WITH {_WIRE} SELECT concat_ws(':', k, key, 'book' || k % 3, name, line) AS selection_id, CASE key WHEN 'totals' THEN 'MATCH_TOTAL' ELSE 'MATCH_RESULT' END AS family, CAST(price AS DOUBLE) AS price, 1703980800000 AS source_ms FROM x WHERE skip IS NULL",
    "stake_rescale": """WITH s AS (SELECT l_orderkey, 250 * (l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)) * (1 + l_tax) AS returned FROM lineitem) SELECT l_orderkey, round(min(returned), 3) AS least, count(*) AS legs FROM s GROUP BY l_orderkey""",
    "bookmaker_grid": f"WITH {_Q}, b AS (SELECT event, slot, odds, max(odds) OVER w AS top, count(*) OVER w AS cells FROM q WINDOW w AS (PARTITION BY event, slot)) SELECT event, slot, max(cells) AS cells, count(*) FILTER (cells > 1 AND odds = top) AS flagged FROM b GROUP BY ALL",
    "guaranteed_over_under": f"WITH {_P}, u AS (SELECT *, 1 / odds_a + 1 / odds_b AS total FROM p WHERE slot_a = 0 AND slot_b = 1) SELECT event, book_a, odds_a, book_b, odds_b, round(100 / odds_a / total, 6) AS stake_a, round(100 / odds_b / total, 6) AS stake_b, round(1 / total - 1, 6) AS roi FROM u WHERE total < 1 AND book_a <> book_b",
}
