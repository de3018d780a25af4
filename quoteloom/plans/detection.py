"""Queries of the detection run, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, register
from ..sources import binding
from .oracles import _MULT, _STATES

QUERIES, SQL = {}, {}

DAY_MS = 86_400_000
POLICY = detection.Policy(now_ms=1_004_918_400_000, max_age_ms=5 * 365 * DAY_MS, max_spread_ms=4 * 365 * DAY_MS)

_RUNS = "SELECT event_id AS run_id, user_id % 10 AS source, epoch_us(ts) // 1000 AS started_ms, CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM events"
#: Selected legs: levels of price, ties in order, then a walk over a group's slots that remembers the books.
_SELECTED = f"""{_STATES},
src AS (SELECT source, max_by(status, (started_ms, run_id)) AS status FROM ({_RUNS}) GROUP BY source),
pr AS (SELECT l_partkey AS event, CASE WHEN l_returnflag = 'R' THEN 'FIRST_HALF' ELSE 'FULL_TIME' END AS period, CAST(slot AS INTEGER) AS slot, l_suppkey AS book, family, participant, line_c, outcome,
  max(round(CAST(base AS DOUBLE) + l_discount * 4 + l_tax * 2, 2)) AS odds, max(epoch_ms(l_shipdate)) AS ms, bool_and(l_quantity = 1) AS suspended FROM lineitem JOIN slots ON slot = l_orderkey % 12 GROUP BY ALL),
pp AS (SELECT pr.*, status, coalesce(status IN ('HEALTHY', 'DEGRADED'), true) AS up, CASE WHEN p_size > 3 THEN round(0.77 + p_size / 250, 3) END AS confidence,
  lpad(CAST(event AS VARCHAR), 9, '0') || ':' || period[:2] || ':' || lpad(CAST(slot AS VARCHAR), 2, '0') || ':' || lpad(CAST(book AS VARCHAR), 9, '0') AS leg_id
  FROM pr LEFT JOIN src ON source = book % 10 LEFT JOIN part ON p_partkey = event),
lv AS (SELECT event, period, slot, coalesce(max(odds) FILTER (up), max(odds)) AS odds FROM pp GROUP BY event, period, slot),
gr AS (SELECT event, period, slot, row_number() OVER (PARTITION BY event, period ORDER BY slot) AS k,
    list({{'leg_id': leg_id, 'book': book, 'odds': odds, 'ms': ms, 'status': status, 'confidence': confidence, 'suspended': suspended}} ORDER BY up DESC, leg_id) AS ties
  FROM pp JOIN lv USING (event, period, slot, odds) GROUP BY event, period, slot),
walk AS (SELECT event, period, slot, k, ties[1] AS leg, [ties[1].book] AS books FROM gr WHERE k = 1
  UNION ALL SELECT event, period, slot, k, leg, list_append(books, leg.book) FROM (
    SELECT g.event, g.period, g.slot, g.k, w.books, coalesce(list_filter(g.ties, lambda t: NOT list_contains(w.books, t.book))[1], g.ties[1]) AS leg FROM walk w JOIN gr g ON g.event = w.event AND g.period = w.period AND g.k = w.k + 1)),
leg AS (SELECT w.event, w.period, w.slot, unnest(w.leg), family, participant, line_c, outcome FROM walk w JOIN slots s ON s.slot = w.slot)"""

_NAMES = """CASE WHEN len(list_distinct(fam)) > 1 THEN CASE WHEN list_contains(fam, 'TEAM_TOTAL') AND list_contains(fam, 'MATCH_TOTAL') THEN 'TEAM_TOTAL_MATCH_TOTAL' WHEN n = 3 THEN 'MULTI_LEG_PARTITION' ELSE 'GENERIC' END
  WHEN fam[1] = 'MATCH_TOTAL' THEN CASE WHEN complement THEN 'SAME_MARKET_COMPLEMENT' ELSE 'COMPLEMENTARY_TOTALS' END WHEN fam[1] = 'ASIAN_TOTAL' THEN 'ASIAN_LINE'
  WHEN fam[1] IN ('MATCH_RESULT', 'DOUBLE_CHANCE') THEN 'PARTITION' WHEN n = 3 THEN 'MULTI_LEG_PARTITION' ELSE 'GENERIC' END"""
#: Candidates with their reasons, verdicts from the states of twos and threes, and the best return over all vertices.
_SCANNED = f"""{_SELECTED},
cand AS (SELECT a.event, a.period, 2 AS n, [a.slot, b.slot] AS slots, [a, b] AS legs, [a.family, b.family] AS fam, complement FROM ok JOIN leg a ON a.slot = slot_a JOIN leg b ON b.event = a.event AND b.period = a.period AND b.slot = slot_b
  UNION ALL SELECT a.event, a.period, 3, [a.slot, b.slot, c.slot], [a, b, c], [a.family, b.family, c.family], false FROM ok JOIN leg a ON a.slot = ok.slot_a JOIN leg b ON b.event = a.event AND b.period = a.period AND b.slot = ok.slot_b
    JOIN leg c ON c.event = a.event AND c.period = a.period AND c.slot > b.slot JOIN ok o2 ON o2.slot_a = a.slot AND o2.slot_b = c.slot JOIN ok o3 ON o3.slot_a = b.slot AND o3.slot_b = c.slot),
rs AS (SELECT *, {_NAMES} AS structure, list_filter([CASE WHEN len(list_filter(legs, lambda x: coalesce(x.confidence < 0.8, false))) > 0 THEN 'EVENT_UNCERTAIN' END,
    CASE WHEN complement AND 1 / legs[1].odds + 1 / legs[2].odds >= 1 THEN 'PRICE_PREFILTER' END, CASE WHEN len(list_distinct(list_transform(legs, lambda x: x.book))) < n THEN 'SAME_BOOKMAKER' END,
    CASE WHEN len(list_filter(legs, lambda x: x.suspended)) > 0 THEN 'SUSPENDED' END], lambda r: r IS NOT NULL) AS reasons FROM cand),
st3 AS (SELECT [CAST(x.slot AS INTEGER), CAST(y.slot AS INTEGER), CAST(z.slot AS INTEGER)] AS slots, [x.result, y.result, z.result] AS r, x.metric = y.metric AS xy, x.metric = z.metric AS xz, y.metric = z.metric AS yz
  FROM sr x JOIN sr y ON x.home = y.home AND x.away = y.away AND x.slot < y.slot JOIN sr z ON z.home = y.home AND z.away = y.away AND y.slot < z.slot WHERE greatest(x.home, x.away) <= greatest(2, greatest(x.bound, y.bound, z.bound) + 1)),
sts AS (SELECT slots, r, (xy AND r[1] > 0 AND r[2] > 0) OR (xz AND r[1] > 0 AND r[3] > 0) OR (yz AND r[2] > 0 AND r[3] > 0) AS overlap FROM st3
  UNION ALL SELECT [slot_a, slot_b], [ra, rb], same AND ra > 0 AND rb > 0 FROM st),
vs AS (SELECT slots, list(DISTINCT r) AS classes, concat_ws('+', CASE WHEN bool_or(list_max(r) = -2) THEN 'BOTH_LOSS_STATE' END, CASE WHEN bool_or(overlap) THEN 'NON_EXCLUSIVE' END,
    CASE WHEN bool_or(list_max(r) <= 0 AND list_max(r) > -2) THEN 'NON_EXHAUSTIVE' END) AS against FROM sts GROUP BY slots),
jd AS (SELECT rs.*, classes, CASE WHEN against = '' THEN 'COVERED' ELSE against END AS verdict FROM rs JOIN vs USING (slots)),
op AS (SELECT event, period, slots, legs, n, unnest(classes) AS c FROM jd WHERE len(reasons) = 0 AND verdict = 'COVERED'),
mt AS (SELECT event, period, slots, n, {_MULT.format(r='c[1]', o='legs[1].odds')} AS x, {_MULT.format(r='c[2]', o='legs[2].odds')} AS y, CASE WHEN n = 3 THEN {_MULT.format(r='c[3]', o='legs[3].odds')} ELSE 0.0 END AS z FROM op),
pt AS (SELECT event, period, slots, unnest([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]) AS w FROM (SELECT DISTINCT event, period, slots FROM mt)
  UNION ALL SELECT i.event, i.period, i.slots, unnest([[j.y - i.y, i.x - j.x, 0.0], [j.z - i.z, 0.0, i.x - j.x], [0.0, j.z - i.z, i.y - j.y]]) FROM mt i JOIN mt j USING (event, period, slots)
  UNION ALL SELECT i.event, i.period, i.slots, [(i.y - j.y) * (i.z - k.z) - (i.z - j.z) * (i.y - k.y), (i.z - j.z) * (i.x - k.x) - (i.x - j.x) * (i.z - k.z), (i.x - j.x) * (i.y - k.y) - (i.y - j.y) * (i.x - k.x)]
    FROM mt i JOIN mt j USING (event, period, slots) JOIN mt k USING (event, period, slots) WHERE i.n = 3),
wt AS (SELECT DISTINCT event, period, slots, list_transform(w, lambda v: v / list_sum(w)) AS w FROM pt WHERE abs(list_sum(w)) > 1e-12),
br AS (SELECT event, period, slots, max(least_return) AS best FROM (
  SELECT event, period, slots, w, min(x * w[1] + y * w[2] + z * w[3]) AS least_return FROM wt JOIN mt USING (event, period, slots) WHERE list_min(w) >= -1e-9 AND (n = 3 OR w[3] = 0) GROUP BY event, period, slots, w) GROUP BY event, period, slots),
sc AS (SELECT jd.*, best, CASE WHEN len(reasons) > 0 THEN 'PRUNED' WHEN verdict <> 'COVERED' THEN 'REJECTED' WHEN round(best, 9) > 1 + 1e-9 THEN 'ARB' ELSE 'NO_ARB' END AS status FROM jd LEFT JOIN br USING (event, period, slots))"""
_FOUND = f"""{_SCANNED},
ar AS (SELECT event, period, slots, structure, best, legs, list_min(list_transform(legs, lambda x: x.ms)) AS first_ms, list_max(list_transform(legs, lambda x: x.ms)) AS last_ms,
  len(list_filter(legs, lambda x: x.confidence IS NULL OR x.status IS NULL)) = 0 AS attested,
  list_filter(list_transform(legs, lambda x: CASE WHEN x.confidence < 0.8 THEN 'EVENT_MATCH_UNCERTAIN' WHEN NOT coalesce(x.status IN ('HEALTHY', 'DEGRADED'), true) THEN 'PROVIDER_UNAVAILABLE' END), lambda r: r IS NOT NULL)[1] AS fault FROM sc WHERE status = 'ARB'),
opp AS (SELECT *, greatest(0, {POLICY.now_ms} - first_ms) AS age, 'episode:' || event || '@' || period || ':' || structure || ':' || list_aggregate(list_sort(list_transform(legs, lambda x: x.leg_id)), 'string_agg', '+') AS key FROM ar),
out AS (SELECT *, CASE WHEN NOT attested THEN 'THEORETICAL_ARB' WHEN age > {POLICY.max_age_ms} THEN 'STALE' WHEN fault IS NOT NULL OR last_ms - first_ms > {POLICY.max_spread_ms} THEN 'REJECTED' ELSE 'VERIFIED_ARB' END AS final FROM opp)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def scans(spark, sf_dir):
    return detection.scanned(binding.priced(spark, sf_dir), binding.slots(spark), POLICY)


@query(f"WITH RECURSIVE {_SELECTED} SELECT event, period, slot, leg_id, odds, book FROM leg")
def detection_selected(spark, sf_dir):
    """The best price of each selection from an available source, books spread."""
    legs = detection.selected(binding.priced(spark, sf_dir)).select(*detection.GROUP, F.explode("legs").alias("leg"))
    return legs.select(*detection.GROUP, "leg.slot", "leg.leg_id", "leg.odds", "leg.book")


@query(f"""WITH RECURSIVE {_SCANNED} SELECT period, array_to_string(slots, ',') AS slots, structure, array_to_string(reasons, '+') AS reasons, verdict, status, count(*) AS candidates, round(max(best), 6) AS largest
    FROM sc GROUP BY ALL""")
def detection_scan(spark, sf_dir):
    """Every candidate of two and three legs: how many of each structure, reasons, verdict and status."""
    keys = [F.array_join("slots", ",").alias("slots"), F.array_join("reasons", "+").alias("reasons")]
    return scans(spark, sf_dir).groupBy("period", keys[0], "structure", keys[1], "verdict", "status").agg(F.count("*").alias("candidates"), F.round(F.max("best_return"), 6).alias("largest"))


@query(f"""WITH RECURSIVE {_FOUND} SELECT key, event, period, array_to_string(slots, ',') AS slots, structure, final AS status,
      CASE final WHEN 'THEORETICAL_ARB' THEN 'INSUFFICIENT_PROVENANCE' WHEN 'STALE' THEN 'STALE_ODDS' WHEN 'REJECTED' THEN coalesce(fault, 'CROSS_SOURCE_TIMESTAMP_SPREAD') END AS rejection,
      round(best * 100, 6) AS min_return, round(best - 1, 6) AS roi, CAST({POLICY.now_ms} - age + {POLICY.max_age_ms} AS BIGINT) AS expires_ms FROM out""")
def detection_run(spark, sf_dir):
    """One detection run over the current prices: all validated opportunities with the best guaranteed return."""
    found = detection.opportunities(detection.scanned(binding.priced(spark, sf_dir), binding.slots(spark), POLICY, only_open=True), POLICY)
    return found.select("key", "event", "period", F.array_join("slots", ",").alias("slots"), "structure", "status", "rejection", F.round("min_return", 6).alias("min_return"), F.round("roi", 6).alias("roi"), "expires_ms")


RUNS = (883_612_800_000, 946_684_800_000, POLICY.now_ms)


def _found_sql(now: int) -> str:
    """The opportunities of a run at another time, over the prices until then."""
    sql = _FOUND.replace("FROM lineitem JOIN", f"FROM (SELECT * FROM lineitem WHERE epoch_ms(l_shipdate) <= {now}) JOIN").replace(str(POLICY.now_ms), str(now))
    return f"SELECT {now} AS now, key, any_value(event) AS event, any_value(structure) AS structure, min(final) AS status FROM (WITH RECURSIVE {sql} SELECT * FROM out) GROUP BY key"


@query(f"""WITH f AS ({' UNION ALL '.join(map(_found_sql, RUNS))})
    SELECT key, any_value(event) AS event, any_value(structure) AS structure, max_by(status, now) AS status, min(now) AS first_ms, max(now) AS last_ms, count(*) AS detected,
      CASE max(now) WHEN {RUNS[0]} THEN {RUNS[1]} WHEN {RUNS[1]} THEN {RUNS[2]} END AS disappeared_ms FROM f GROUP BY key""")
def detection_episodes(spark, sf_dir):
    """Episodes of opportunities over three runs, each over the prices until its time."""
    lines, episodes = binding.table(spark, sf_dir, "lineitem"), spark.createDataFrame([], detection.EPISODE)
    for now in RUNS:
        policy = POLICY._replace(now_ms=now)
        prices = binding.priced(spark, sf_dir, lines.where(F.unix_millis(F.col("l_shipdate").cast("timestamp")) <= now))
        found = detection.opportunities(detection.scanned(prices, binding.slots(spark), policy, only_open=True), policy)
        episodes = detection.folded(episodes, found, now)
    return episodes


#: Events that start before this are stored already; the others are observed in the order of their start.
STORED_UNTIL_MS, ROUNDS = 789_523_200_000, 8
_NEAR = 7_200_000


def _round_sql(k: int) -> str:
    """One round: who is free, who creates, what the others are, which sources are bound, who is a duplicate then."""
    return f""", f{k} AS MATERIALIZED (SELECT ob.* FROM ob ANTI JOIN d{k - 1} ON d{k - 1}.id = ob.id),
c{k} AS MATERIALIZED (SELECT arg_min(id, (at_ms, id)) AS id, home, away, arg_min(competition, (at_ms, id)) AS competition, arg_min(start_ms, (at_ms, id)) AS start_ms FROM f{k} ANTI JOIN sd ON sd.home = f{k}.home AND sd.away = f{k}.away WHERE home <> away GROUP BY home, away),
s{k} AS (SELECT id, home, away, competition, start_ms FROM sd UNION ALL SELECT id, home, away, competition, start_ms FROM c{k}),
m{k} AS (SELECT f.id, s.id AS other, 0.5 + CASE WHEN abs(f.start_ms - s.start_ms) <= {_NEAR} THEN 0.3 ELSE 0 END + CASE WHEN f.competition = s.competition THEN 0.2 ELSE -0.2 END AS score FROM f{k} f JOIN s{k} s ON s.home = f.home AND s.away = f.away),
b{k} AS (SELECT id, arg_max(other, (score, -other)) AS other, max(score) AS score FROM m{k} GROUP BY id),
x{k} AS MATERIALIZED (SELECT f.*, CASE WHEN c.id IS NOT NULL THEN 'created' WHEN score >= 0.8 THEN 'merged' ELSE 'uncertain' END AS action, CASE WHEN c.id IS NOT NULL THEN c.id WHEN score >= 0.8 THEN other END AS event_id,
  CASE WHEN c.id IS NOT NULL THEN 1.0 WHEN score >= 0.8 THEN score ELSE 0.0 END AS confidence FROM f{k} f LEFT JOIN c{k} c ON c.id = f.id LEFT JOIN b{k} b ON b.id = f.id),
y{k} AS (SELECT provider, source_id, arg_min(event_id, (at_ms, id)) AS bound, min((at_ms, id)) AS at FROM (
  SELECT provider, source_id, event_id, at_ms, id FROM x{k} WHERE event_id IS NOT NULL UNION ALL SELECT provider, source_id, id, -1, id FROM sd) GROUP BY provider, source_id),
d{k} AS MATERIALIZED (SELECT ob.id, bound FROM ob JOIN y{k} USING (provider, source_id) WHERE (ob.at_ms, ob.id) > y{k}.at)"""


@query(f"""WITH pe AS (SELECT o_orderkey AS id, o_orderkey % 2 AS provider, o_orderkey // 8 AS source_id, n_name AS home, c_mktsegment AS away, o_orderpriority AS competition, epoch_ms(o_orderdate) AS start_ms, epoch_ms(o_orderdate) AS at_ms
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    sd AS MATERIALIZED (SELECT * FROM pe WHERE start_ms < {STORED_UNTIL_MS}), ob AS MATERIALIZED (SELECT * FROM pe WHERE start_ms >= {STORED_UNTIL_MS}),
    d0 AS (SELECT id, id AS bound FROM ob WHERE false){''.join(_round_sql(k) for k in range(1, ROUNDS + 1))}
    SELECT id, action, event_id, CAST(confidence AS DOUBLE) AS confidence, false AS duplicate FROM x{ROUNDS} UNION ALL SELECT id, 'merged', bound, 1.0, true FROM d{ROUNDS}""")
def event_register(spark, sf_dir):
    """What each observation becomes after the events that are stored: a source names two providers' events by eights of their ids."""
    events = binding.provider_events(spark, sf_dir).withColumn("source_id", F.floor(F.col("id") / 8)).withColumn("at_ms", F.col("start_ms"))
    before = F.col("start_ms") < STORED_UNTIL_MS
    return register.register(events.where(~before), events.where(before), _NEAR)
