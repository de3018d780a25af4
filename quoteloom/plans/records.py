"""Queries on provider records, pruning of candidates, merging of events and reports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import settle
from ..operators import candidates, history, labels, ops, quotes, reconcile, reports
from ..sources import binding, market

QUERIES, SQL = {}, {}

FAMILIES = [*(s[0] for s in market.SPECS), "OUTRIGHT"]
TYPES = ["1X2", "DOUBLE_CHANCE", "STANDARD", "ASIAN", "HANDICAP", "BTTS", "EXACT_SCORE"]
NAMES = [*market.OUTCOMES, "2-1", "x-1", "10-0"]
LABELS = [
    "Team  Alpha", " team beta", "Draw", "x", "TIE", "П1", "p2", "Over 2.5", "over", "O", "u", "Under (3)", "Yes", "n", "NO", "y", "1X", "x2", "12", "home/draw",
    "Draw or  Away", "Home or Away", "2:1", "Correct Score 3 - 10", "12-3", "0-0", "", "maybe", "1 2", "x1", "2x",
]
WORDS = ["live", "completed", "final", "postponed", "cancelled", "abandoned", "scheduled", "weird"]
HEADERS = ["10", " 7 ", "", "-1", "1.5", "1e3", None, "abc", "0"]
LINES = ["+2.5", "2,5", " -0.25 ", "abc", "1.", "1,5,0", "", ".5", "3", "-+1"]
CAP = 20_000
NOW_MS, MAX_AGE_MS = 1_000_000_000_000, 2 * 365 * 86_400_000
BIND_SQL = "pe AS (SELECT o_orderkey AS id, o_orderkey % 2 AS provider, n_name AS home, c_mktsegment AS away, o_orderpriority AS competition, epoch_ms(o_orderdate) AS start_ms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _pick(values, at):
    """One of fixed values by a number."""
    return F.get(F.array(*(F.lit(v) for v in values)), (at % len(values)).cast("int"))


def _pick_sql(values, at):
    items = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"[{items}][{at} % {len(values)} + 1]"


def _orders(spark, sf_dir) -> DataFrame:
    return binding.table(spark, sf_dir, "orders")


def _lines(spark, sf_dir) -> DataFrame:
    return binding.table(spark, sf_dir, "lineitem")


_SPEC_SQL = "spec(family, type, takes_p, takes_l, names) AS (VALUES " + ", ".join(f"('{f}', '{t}', {p}, {n}, {names or ['-']})" for f, t, p, n, names in market.SPECS) + ")"


@query(f"""WITH {_SPEC_SQL}, m AS (SELECT l_orderkey, {_pick_sql(FAMILIES, 'l_partkey')} AS family, CASE WHEN l_orderkey % 3 > 0 THEN 1 END AS same, {_pick_sql(TYPES, 'l_suppkey')} AS own, CASE l_linenumber % 3 WHEN 0 THEN 'HOME' WHEN 1 THEN 'AWAY' END AS participant,
      CASE WHEN l_orderkey % 2 = 0 THEN '2.5' END AS line, {_pick_sql(NAMES, 'CAST(l_quantity AS BIGINT)')} AS outcome FROM lineitem),
    j AS (SELECT m.*, spec.* EXCLUDE (family), CASE WHEN same = 1 AND spec.family IS NOT NULL THEN type ELSE own END AS market_type, spec.family IS NOT NULL AS known FROM m LEFT JOIN spec USING (family))
    SELECT l_orderkey, concat_ws('|', family, 'FULL_MATCH', market_type, coalesce(participant, '_'), coalesce(line, '_')) AS structure_key,
      CASE WHEN NOT known THEN 'unknown_family' ELSE concat_ws('+', CASE WHEN market_type <> type THEN 'market_type' END, CASE WHEN takes_p AND participant IS NULL THEN 'participant_missing' WHEN NOT takes_p AND participant IS NOT NULL THEN 'participant_extra' END,
        CASE WHEN takes_l AND line IS NULL THEN 'line_missing' WHEN NOT takes_l AND line IS NOT NULL THEN 'line_extra' END,
        CASE WHEN family = 'EXACT_SCORE' THEN CASE WHEN NOT regexp_full_match(outcome, '[0-9]+-[0-9]+') THEN 'outcome' END WHEN NOT list_contains(names, outcome) THEN 'outcome' END) END AS problems FROM j""")
def structure_check(spark, sf_dir):
    """Market records against the families' rules, with their keys."""
    family = _pick(FAMILIES, F.col("l_partkey"))
    kind = F.create_map(*(F.lit(x) for s in market.SPECS for x in s[:2]))
    stated = F.coalesce(F.when(F.col("l_orderkey") % 3 > 0, F.try_element_at(kind, family)), _pick(TYPES, F.col("l_suppkey")))
    side = F.when(F.col("l_linenumber") % 3 == 0, "HOME").when(F.col("l_linenumber") % 3 == 1, "AWAY")
    rows = _lines(spark, sf_dir).select(
        "l_orderkey", family.alias("family"), stated.alias("market_type"), side.alias("participant"), F.when(F.col("l_orderkey") % 2 == 0, "2.5").alias("line"), _pick(NAMES, F.col("l_quantity").cast("long")).alias("outcome")
    )
    key = market.structure_key(F.col("family"), F.lit("FULL_MATCH"), F.col("market_type"), F.col("participant"), F.col("line"))
    return market.structure_problems(rows).select("l_orderkey", key.alias("structure_key"), F.array_join("problems", "+").alias("problems"))


@query(f"""WITH f(family, kind) AS (VALUES ('MATCH_RESULT', 'r'), ('DOUBLE_CHANCE', 'd'), ('MATCH_TOTAL', 't'), ('ASIAN_TOTAL', 't'), ('ASIAN_HANDICAP', 'h'), ('TEAM_TOTAL', 't'), ('TEAM_ASIAN_TOTAL', 't'), ('CORNERS', 't'), ('CARDS', 't'), ('BTTS', 'b'), ('EXACT_SCORE', 'e')),
    o AS (SELECT o_orderkey, {_pick_sql(FAMILIES, 'o_custkey')} AS family, {_pick_sql(LABELS, 'o_orderkey')} AS name FROM orders),
    t AS (SELECT o_orderkey, kind, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS t FROM o LEFT JOIN f USING (family)),
    x(kind, t, outcome) AS (VALUES ('r', 'team alpha', 'HOME'), ('h', 'team alpha', 'HOME'), ('r', 'team beta', 'AWAY'), ('h', 'team beta', 'AWAY'), ('r', 'draw', 'DRAW'), ('r', 'x', 'DRAW'), ('r', 'tie', 'DRAW'), ('r', 'п1', 'HOME'), ('r', 'p2', 'AWAY'),
      ('b', 'yes', 'BTTS_YES'), ('b', 'y', 'BTTS_YES'), ('b', 'no', 'BTTS_NO'), ('b', 'n', 'BTTS_NO'), ('d', '1x', 'HOME_OR_DRAW'), ('d', 'x1', 'HOME_OR_DRAW'), ('d', 'home/draw', 'HOME_OR_DRAW'), ('d', 'x2', 'AWAY_OR_DRAW'), ('d', '2x', 'AWAY_OR_DRAW'),
      ('d', 'draw or away', 'AWAY_OR_DRAW'), ('d', '12', 'HOME_OR_AWAY'), ('d', 'home or away', 'HOME_OR_AWAY'), ('t', 'o', 'OVER'), ('t', 'u', 'UNDER')),
    m AS (SELECT o_orderkey, coalesce(outcome, CASE WHEN t.kind = 't' AND t.t LIKE 'over%' THEN 'OVER' WHEN t.kind = 't' AND t.t LIKE 'under%' THEN 'UNDER'
      WHEN t.kind = 'e' THEN nullif(regexp_extract(t.t, '(\\d{{1,3}})\\D{{0,2}}(\\d{{1,3}})', 1) || '-' || regexp_extract(t.t, '(\\d{{1,3}})\\D{{0,2}}(\\d{{1,3}})', 2), '-') END) AS outcome FROM t LEFT JOIN x ON x.kind = t.kind AND x.t = t.t)
    SELECT o_orderkey, outcome, CASE WHEN NOT contains(outcome, '-') THEN outcome END AS stored FROM m""")
def outcome_map(spark, sf_dir):
    """Providers' labels as outcomes, and as what the store can hold."""
    found = market.map_outcome(_pick(FAMILIES, F.col("o_custkey")), _pick(LABELS, F.col("o_orderkey")), F.lit("Team Alpha"), F.lit("Team Beta"))
    return _orders(spark, sf_dir).select("o_orderkey", found.alias("outcome")).withColumn("stored", market.representable(F.col("outcome")))


@query(f"""WITH o AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'odds-api' ELSE 'parlay-api' END AS provider, CASE WHEN o_orderkey % 11 > 0 THEN {_pick_sql(WORDS, 'o_orderkey')} END AS word FROM orders)
    SELECT provider, word, CASE WHEN word IN ('postponed', 'cancelled', 'abandoned', 'live') THEN upper(word) WHEN word = 'completed' OR (word = 'final' AND provider = 'parlay-api') THEN 'FINISHED' ELSE 'SCHEDULED' END AS status, count(*) AS events FROM o GROUP BY ALL""")
def status_map(spark, sf_dir):
    """Events by each provider's word for their status."""
    provider, word = F.when(F.col("o_custkey") % 2 == 0, "odds-api").otherwise("parlay-api"), F.when(F.col("o_orderkey") % 11 > 0, _pick(WORDS, F.col("o_orderkey")))
    rows = _orders(spark, sf_dir).select(provider.alias("provider"), word.alias("word"))
    return rows.groupBy("provider", "word", market.map_status(F.col("provider"), F.col("word")).alias("status")).agg(F.count("*").alias("events"))


_QUOTA_SQL = "CASE WHEN regexp_full_match(trim({0}), '[0-9]+') THEN CAST(trim({0}) AS BIGINT) WHEN {0} = '1e3' THEN 1000 END"


@query(f"""WITH h AS (SELECT o_orderkey, {_pick_sql(HEADERS, 'o_orderkey')} AS a, {_pick_sql(HEADERS, 'o_custkey')} AS b FROM orders)
    SELECT o_orderkey, {_QUOTA_SQL.format('a')} AS remaining, {_QUOTA_SQL.format('b')} AS used, coalesce(remaining, used) IS NOT NULL AS reported FROM h""")
def quota_headers(spark, sf_dir):
    """Quota headers as numbers, and whether a provider reported any."""
    rows = _orders(spark, sf_dir).select("o_orderkey", market.quota(_pick(HEADERS, F.col("o_orderkey"))).alias("remaining"), market.quota(_pick(HEADERS, F.col("o_custkey"))).alias("used"))
    return rows.withColumn("reported", F.coalesce("remaining", "used").isNotNull())


@query(f"""WITH l AS (SELECT {_pick_sql(LINES, 'o_orderkey')} AS raw FROM orders)
    SELECT raw, CASE raw WHEN '+2.5' THEN '2.5' WHEN '2,5' THEN '2.5' WHEN ' -0.25 ' THEN '-0.25' WHEN '3' THEN '3' END AS line, count(*) AS n FROM l GROUP BY ALL""")
def canonical_line(spark, sf_dir):
    """Lines as providers write them in canonical form."""
    raw = _pick(LINES, F.col("o_orderkey"))
    return _orders(spark, sf_dir).groupBy(raw.alias("raw"), market.canonical_line(raw).alias("line")).agg(F.count("*").alias("n"))


_LEGS_SQL = (
    "slots(slot, family, market_type, participant, line_c, outcome, base) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in binding.SLOTS) + "),"
    " legs AS (SELECT l_orderkey AS id, slot, family, participant, line_c, outcome, l_partkey % 29 = 0 AS elsewhere, l_partkey % 23 = 0 AS half, l_suppkey % 50 AS book, CASE WHEN l_quantity = 50 THEN 1.0 ELSE round(CAST(base AS DOUBLE) + l_discount * 4, 2) END AS odds,"
    " l_partkey % 31 = 0 AS suspended, CASE WHEN l_partkey % 37 = 0 THEN 0.5 WHEN l_partkey % 5 = 3 THEN 0.9 END AS confidence, epoch_ms(l_shipdate) AS ms FROM lineitem JOIN slots ON slot = l_suppkey % 12)"
)


@query(f"""WITH {_LEGS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY id) AS n, count(*) OVER (PARTITION BY id) AS c FROM legs),
    g AS (SELECT id, count(*) AS c, bool_or(elsewhere) AS elsewhere, bool_or(half) AS half, count(DISTINCT (slot, half)) AS keys, bool_or(odds <= 1) AS bad, bool_or(suspended) AS suspended, bool_or(1000000000000 - ms > 63072000000) AS stale, count(DISTINCT book) AS books,
      bool_or(coalesce(confidence, 1) < 0.8) AS unsure FROM legs GROUP BY id),
    okay(a, b) AS (VALUES ('MATCH_TOTAL', 'TEAM_TOTAL'), ('ASIAN_TOTAL', 'MATCH_TOTAL'), ('ASIAN_TOTAL', 'TEAM_TOTAL'), ('DOUBLE_CHANCE', 'MATCH_RESULT'), ('BTTS', 'MATCH_TOTAL')),
    w AS (SELECT DISTINCT x.id FROM n x JOIN n y ON x.id = y.id AND x.family < y.family LEFT JOIN okay ON okay.a = x.family AND okay.b = y.family WHERE okay.a IS NULL),
    p AS (SELECT x.id FROM n x JOIN n y ON x.id = y.id AND x.c = 2 AND x.n = 1 AND y.n = 2 WHERE x.half = y.half AND x.family = y.family AND x.line_c IS NOT DISTINCT FROM y.line_c AND x.participant IS NOT DISTINCT FROM y.participant
      AND (least(x.outcome, y.outcome), greatest(x.outcome, y.outcome)) IN (('OVER', 'UNDER'), ('BTTS_NO', 'BTTS_YES'), ('AWAY', 'HOME')) AND 1 / x.odds + 1 / y.odds >= 1),
    v AS (SELECT g.id, list_filter([CASE WHEN c < 2 THEN 'CANDIDATE_SIZE' END, CASE WHEN keys < c THEN 'DUPLICATE_SELECTION' END, CASE WHEN elsewhere THEN 'EVENT_MISMATCH' END, CASE WHEN unsure THEN 'EVENT_UNCERTAIN' END, CASE WHEN w.id IS NOT NULL THEN 'INCOMPATIBLE_MARKET' END,
      CASE WHEN bad THEN 'INVALID_ODDS' END, CASE WHEN half THEN 'PERIOD_MISMATCH' END, CASE WHEN p.id IS NOT NULL THEN 'PRICE_PREFILTER' END, CASE WHEN c > 1 AND books < c THEN 'SAME_BOOKMAKER' END, CASE WHEN stale THEN 'STALE_ODDS' END, CASE WHEN suspended THEN 'SUSPENDED' END], lambda x: x IS NOT NULL) AS r
      FROM g LEFT JOIN w USING (id) LEFT JOIN p USING (id))
    SELECT id, array_to_string(r, '+') AS reasons, array_to_string(list_sort(list_distinct(list_transform(r, lambda x: CASE x WHEN 'CANDIDATE_SIZE' THEN 'INVALID_MARKET' WHEN 'DUPLICATE_SELECTION' THEN 'INVALID_MARKET' WHEN 'SUSPENDED' THEN 'INVALID_MARKET'
      WHEN 'SAME_BOOKMAKER' THEN 'STAKE_LIMIT' WHEN 'EVENT_UNCERTAIN' THEN 'EVENT_MATCH_UNCERTAIN' WHEN 'INCOMPATIBLE_MARKET' THEN 'UNSUPPORTED_MARKET' WHEN 'PRICE_PREFILTER' THEN 'NEGATIVE_GUARANTEED_PROFIT' ELSE x END))), '+') AS rejections FROM v""")
def prune_all_reasons(spark, sf_dir):
    """All eleven reasons against candidates of one to many legs, an order's lines, and what is reported for them."""
    c = F.col
    odds = F.when(c("l_quantity") == 50, 1.0).otherwise(F.round(c("base") + c("l_discount") * 4, 2))
    leg = F.struct(
        F.when(c("l_partkey") % 29 == 0, c("l_orderkey") + 1).otherwise(c("l_orderkey")).alias("event"), F.when(c("l_partkey") % 23 == 0, "FIRST_HALF").otherwise("FULL_MATCH").alias("period"),
        "family", "participant", "line_c", "outcome", (c("l_suppkey") % 50).alias("book"), odds.alias("odds"), (c("l_partkey") % 31 == 0).alias("suspended"),
        F.when(c("l_partkey") % 37 == 0, 0.5).when(c("l_partkey") % 5 == 3, 0.9).alias("confidence"), F.unix_millis(c("l_shipdate").cast("timestamp")).alias("observed_ms"),
    )
    rows = _lines(spark, sf_dir).withColumn("slot", (c("l_suppkey") % 12).cast("int")).join(F.broadcast(binding.slots(spark)), "slot")  # 12 rows
    found = rows.groupBy(c("l_orderkey").alias("id")).agg(F.collect_list(leg).alias("legs"))  # the lines of one order
    pruned = found.select("id", candidates.prune(c("legs"), c("id"), F.lit("FULL_MATCH"), NOW_MS, MAX_AGE_MS).alias("r"))
    return pruned.select("id", F.array_join("r", "+").alias("reasons"), F.array_join(candidates.rejections(c("r")), "+").alias("rejections"))


@query("""WITH s AS (SELECT l_orderkey, 's' || l_suppkey % 12 AS id FROM lineitem), g AS (SELECT l_orderkey, list(id) AS ids FROM s GROUP BY 1), d AS (SELECT l_orderkey, string_agg(id, ',' ORDER BY id) AS again FROM (SELECT l_orderkey, id FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(ids)), ',') AS leg_key, 'episode:' || l_orderkey || ':GENERIC:' || array_to_string(list_sort(list_distinct(ids)), '+') AS episode_key, coalesce(again, '') AS duplicates FROM g LEFT JOIN d USING (l_orderkey)""")
def episode_keys(spark, sf_dir):
    """Keys of legs and episodes, and legs named twice."""
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey") % 12)).alias("ids"))
    ids = F.col("ids")
    return rows.select("l_orderkey", candidates.leg_key(ids).alias("leg_key"), candidates.episode_key(F.col("l_orderkey"), F.lit("GENERIC"), ids).alias("episode_key"), F.array_join(candidates.duplicates(ids), ",").alias("duplicates"))


def _stored_events(spark, sf_dir):
    e = binding.provider_events(spark, sf_dir)
    return e.withColumn("provider", F.when(F.col("provider") == 0, "odds-api").otherwise("parlay-api")).withColumn("created_ms", F.col("id"))


_FOLD_SQL = f"""{BIND_SQL}, near AS (SELECT p.id, min(CASE WHEN p.competition = q.competition THEN q.id END) AS sure, min(q.id) AS beside FROM pe p JOIN pe q ON p.provider = 1 AND q.provider = 0 AND p.home = q.home AND p.away = q.away AND abs(p.start_ms - q.start_ms) <= 7200000 GROUP BY p.id),
    f AS (SELECT p.*, sure, beside, (SELECT min(id) FROM pe q WHERE q.provider = 0 AND q.home = p.home AND q.away = p.away AND q.competition = p.competition) AS same, (SELECT min(id) FROM pe q WHERE q.provider = 0 AND q.home = p.home AND q.away = p.away) AS any_one FROM pe p LEFT JOIN near USING (id)),
    plan AS (SELECT id, CASE WHEN provider = 1 THEN coalesce(sure, id) ELSE id END AS winner_id, CASE WHEN provider = 1 AND sure IS NOT NULL THEN 1.0 END AS score, CASE WHEN provider = 1 AND sure IS NULL THEN coalesce(same, beside, any_one) END AS uncertain_id,
      CASE WHEN provider = 1 AND sure IS NULL THEN CASE WHEN same IS NOT NULL THEN 0.7 WHEN beside IS NOT NULL THEN 0.6 WHEN any_one IS NOT NULL THEN 0.3 END END AS uncertain_score FROM f)"""


@query(f"WITH {_FOLD_SQL} SELECT id, winner_id, CAST(score AS DOUBLE) AS score, uncertain_id, CAST(uncertain_score AS DOUBLE) AS uncertain_score, count(*) OVER (PARTITION BY winner_id) AS members FROM plan")
def event_fold(spark, sf_dir):
    """Which stored events are one, as the better provider names it, and which may be."""
    return reconcile.fold_events(_stored_events(spark, sf_dir))


@query(f"""WITH {_FOLD_SQL}, r AS (SELECT winner_id, id, l_linenumber FROM lineitem JOIN plan ON id = l_orderkey), k AS (SELECT winner_id, l_linenumber, bool_or(id = winner_id) AS own, count(*) AS n FROM r GROUP BY ALL)
    SELECT winner_id, count(*) AS kept, count(*) FILTER (NOT own) AS moved, CAST(sum(n) - count(*) AS BIGINT) AS dropped FROM k GROUP BY winner_id""")
def event_merge(spark, sf_dir):
    """What merging events does to their rows."""
    return reconcile.merge_rows(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber"), reconcile.fold_events(_stored_events(spark, sf_dir)), "l_orderkey", ["l_linenumber"])


_MERGED_SQL = f"""{_FOLD_SQL}, r AS (SELECT winner_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY winner_id, l_linenumber ORDER BY l_orderkey <> winner_id, l_orderkey, l_partkey, l_suppkey, l_quantity) AS n,
      first_value(l_orderkey) OVER (PARTITION BY winner_id, l_linenumber ORDER BY l_orderkey <> winner_id, l_orderkey) AS kept_from FROM lineitem JOIN plan ON id = l_orderkey)"""


def _merged(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return reconcile.merged_rows(rows, reconcile.fold_events(_stored_events(spark, sf_dir)), "l_orderkey", ["l_linenumber"])


@query(f"WITH {_MERGED_SQL} SELECT winner_id AS l_orderkey, l_linenumber, l_orderkey AS from_event, l_orderkey <> winner_id AS moved, l_partkey, l_suppkey, l_quantity FROM r WHERE n = 1")
def event_merge_applied(spark, sf_dir):
    """The rows themselves after merging events, pointing to the survivors."""
    return _merged(spark, sf_dir)[0]


@query(f"WITH {_MERGED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, winner_id, kept_from FROM r WHERE n > 1")
def event_merge_conflicts(spark, sf_dir):
    """The rows that a merge drops as their survivor has their key already, and whose row stays."""
    return _merged(spark, sf_dir)[1]


_RANKED = ["parlay-api", "other", "odds-api"]


@query(f"""WITH q AS (SELECT l_partkey AS event, l_orderkey % 12 AS slot, l_suppkey AS book, max(epoch_ms(l_shipdate)) AS ms, [1, 2, 0][l_suppkey % 3 + 1] AS rank FROM lineitem GROUP BY ALL)
    SELECT event, CAST(slot AS INTEGER) AS slot, arg_min(book, (rank, book)) AS primary, arg_min(book, (rank, book)) <> arg_min(book, (ms, book)) AS promoted FROM q GROUP BY ALL""")
def primary_promotion(spark, sf_dir):
    """The row of the most trusted provider takes a selection's identity."""
    q = binding.quotes(spark, sf_dir).select("event", "slot", "book", "observed_ms", _pick(_RANKED, F.col("book")).alias("provider"))
    return reconcile.promote(q, ["event", "slot"], "book", "observed_ms")


_RUNS_SQL = "r AS (SELECT event_id AS run_id, user_id % 10 AS source, epoch_us(ts) // 1000 AS started_ms, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS latency_ms, CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, user_id, event_type FROM events)"


@query(f"""WITH {_RUNS_SQL}, k AS (SELECT user_id, arg_max((status, event_type, source), (started_ms, run_id)) AS x, max(started_ms) - min(started_ms) AS d FROM r GROUP BY user_id), e AS (SELECT x[1] AS status, d, CASE WHEN x[1] <> 'HEALTHY' THEN x[2] || ':' || x[3] END AS reason FROM k),
    t AS (SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5)
    SELECT 'status' AS section, status AS name, count(*) AS n, round(avg(d), 3) AS avg_ms FROM e GROUP BY status UNION ALL SELECT 'reason', reason, n, NULL FROM t""")
def false_positive_report(spark, sf_dir):
    """Episodes by latest status with durations, and the commonest reasons."""
    e = binding.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("run_id"))
    rows = binding.runs(spark, sf_dir).join(e, "run_id")
    at = F.struct("started_ms", "run_id")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("status", "event_type", "source"), at).alias("x"), (F.max("started_ms") - F.min("started_ms")).alias("duration_ms"))
    reason = F.when(F.col("x.status") != "HEALTHY", F.concat_ws(":", "x.event_type", F.col("x.source").cast("string")))
    return reports.false_positive_report(last.select("x.status", reason.alias("reason"), "duration_ms"))


@query(f"WITH {_RUNS_SQL} SELECT started_ms // 600000 AS cycle, CASE WHEN count(DISTINCT status) = 1 AND count(*) FILTER (latency_ms > 90000) = 0 THEN min(status) ELSE 'DEGRADED' END AS status FROM r GROUP BY 1")
def cycle_status(spark, sf_dir):
    """The status of ten-minute cycles from those of their sources; a run beyond 90 s stands for an error."""
    rows = binding.runs(spark, sf_dir).withColumn("cycle", F.floor(F.col("started_ms") / 600_000))
    return reports.cycle_status(rows, ["cycle"], F.col("latency_ms") > 90_000)


@query(f"WITH {_RUNS_SQL} SELECT run_id, source, started_ms, status FROM r ORDER BY started_ms DESC, run_id DESC LIMIT 50")
def latest_runs(spark, sf_dir):
    """The 50 latest runs."""
    return reports.newest(binding.runs(spark, sf_dir).select("run_id", "source", "started_ms", "status"), "started_ms", "run_id", 50)


@query(f"WITH {_RUNS_SQL} SELECT source, count(*) AS runs, max(started_ms) AS last_run_ms, round(avg(latency_ms), 6) AS avg_ms FROM r GROUP BY source ORDER BY last_run_ms DESC, source DESC LIMIT 5")
def latest_sources(spark, sf_dir):
    """Latency of the five sources that ran last."""
    return reports.newest(history.latency(binding.runs(spark, sf_dir)).select("source", "runs", "last_run_ms", "avg_ms"), "last_run_ms", "source", 5)


@query("SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN l_partkey % 5 > 0 THEN 1 END) THEN min(CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 10) / 10 END) END AS confidence FROM lineitem GROUP BY l_orderkey")
def min_confidence(spark, sf_dir):
    """The smallest confidence of an event's bindings, where all of them state one."""
    rows = _lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 10 / 10).alias("own"))
    return reports.least_confidence(rows, ["l_orderkey"], "own")


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderkey % 3 AS h1, o_custkey % 2 AS a1, o_orderkey % 3 + o_custkey % 3 AS h2, o_custkey % 2 + o_orderkey % 2 AS a2, o_orderkey % 4 > 0 AS has1, o_custkey % 5 > 0 AS has2, o_custkey % 7 = 0 AS own FROM orders)
    SELECT k AS match, 'FULL_MATCH' AS period, CASE WHEN has2 THEN h2 END AS home, CASE WHEN has2 THEN a2 END AS away FROM m UNION ALL SELECT k, 'FIRST_HALF', CASE WHEN has1 THEN h1 END, CASE WHEN has1 THEN a1 END FROM m
    UNION ALL SELECT k, 'SECOND_HALF', CASE WHEN own THEN 9 WHEN has1 AND has2 THEN h2 - h1 END, CASE WHEN own THEN 8 WHEN has1 AND has2 THEN a2 - a1 END FROM m UNION ALL SELECT k, 'EXTRA_TIME', NULL, NULL FROM m UNION ALL SELECT k, 'PENALTIES', 5, 4 FROM m""")
def period_score(spark, sf_dir):
    """The scores of a match's periods, second halves from the others where they aren't stated."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = lambda h, a: F.struct(h.cast("long").alias("home"), a.cast("long").alias("away"))
    lit = lambda h, a: score(F.lit(h), F.lit(a))
    first, full = F.when(k % 4 > 0, score(k % 3, c % 2)), F.when(c % 5 > 0, score(k % 3 + c % 3, c % 2 + k % 2))
    periods = F.explode(F.array(*map(F.lit, ["FULL_MATCH", "FIRST_HALF", "SECOND_HALF", "EXTRA_TIME", "PENALTIES"])))
    rows = _orders(spark, sf_dir).select("*", periods.alias("period"))
    found = market.period_score(F.col("period"), first, full, F.when(c % 7 == 0, lit(9, 8)), F.when(F.lit(False), lit(0, 0)), lit(5, 4))
    return rows.select(k.alias("match"), "period", found.alias("s")).select("match", "period", "s.home", "s.away")


_STATES = [*market.LEVELS, "HEALTHY", "DOWN", "UNKNOWN"]


@query(f"WITH s AS (SELECT {_pick_sql(_STATES, 'o_orderkey')} AS state FROM orders) SELECT state, CASE WHEN state IN ('ok', 'starting', 'HEALTHY') THEN 'HEALTHY' WHEN state IN ('degraded', 'UNKNOWN') THEN 'DEGRADED' ELSE 'DOWN' END AS level, count(*) AS n FROM s GROUP BY ALL")
def alert_levels(spark, sf_dir):
    """Alert levels of workers and sources."""
    state = _pick(_STATES, F.col("o_orderkey"))
    return _orders(spark, sf_dir).groupBy(state.alias("state"), market.alert_level(state).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS VARCHAR) || '?~' END AS v, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders")
def cursor_round_trip(spark, sf_dir):
    """Cursors encoded and decoded again; broken ones give null."""
    k = F.col("o_orderkey")
    whole = ops.cursor(F.concat(F.col("o_custkey"), F.lit("?~")), k)
    sent = F.when(k % 4 > 0, whole).when(k % 8 == 0, F.lit("%%%")).otherwise(F.substring(whole, 1, 9))
    return _orders(spark, sf_dir).select("o_orderkey", reports.decode_cursor(sent).alias("c")).select("o_orderkey", "c.v", "c.id")


@query(f"WITH {_RUNS_SQL}, d AS (SELECT DISTINCT user_id, status, started_ms < 1706400000000 AS early FROM r) SELECT user_id, status FROM d WHERE early EXCEPT SELECT user_id, status FROM d WHERE NOT early")
def conditions_gone(spark, sf_dir):
    """Conditions of the days before the 28th that the days from then on no longer have."""
    e = binding.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("run_id"))
    rows = binding.runs(spark, sf_dir).join(e, "run_id").select("user_id", "status", (F.col("started_ms") < 1_706_400_000_000).alias("early"))
    return reports.gone(rows.where("early"), rows.where("not early"), ["user_id", "status"])


@query("SELECT n_name, coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), '') AS links FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 = 0 GROUP BY n_nationkey, n_name")
def event_links(spark, sf_dir):
    """Parents with their links nested, also those without any."""
    n, s = (binding.table(spark, sf_dir, t) for t in ("nation", "supplier"))
    links = s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    found = reports.nested(n, links, "n_nationkey", ["s_suppkey"], "links")
    return found.select("n_name", F.array_join(F.transform("links", lambda x: x["s_suppkey"].cast("string")), ",").alias("links"))


@query("SELECT o_orderkey, string_agg(l_suppkey || ':' || l_linenumber, ',' ORDER BY l_suppkey, l_linenumber) AS bindings FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def event_seeds(spark, sf_dir):
    """Events with the bindings that providers have for them."""
    b = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    found = reports.nested(_orders(spark, sf_dir).select("o_orderkey"), b, "o_orderkey", ["l_suppkey", "l_linenumber"], "b").where(F.size("b") > 0)
    return found.select("o_orderkey", F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["l_suppkey"].cast("string"), x["l_linenumber"].cast("string"))), ",").alias("bindings"))


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey % 2 = 1 OR l_partkey NOT IN (SELECT p_partkey FROM part)")
def dimension_new_keys(spark, sf_dir):
    """Keys that a dimension, here the even parts, is yet to get."""
    return reports.new_keys(binding.table(spark, sf_dir, "part").where("p_partkey % 2 = 0"), _lines(spark, sf_dir).select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


_BEST_SQL = "WITH " + _LEGS_SQL.split(", legs AS")[0].rstrip(", ") + (
    ", q AS (SELECT l_partkey AS event, slot, l_suppkey AS book, max(round(CAST(base AS DOUBLE) + l_discount * 4 + l_tax * 2, 2)) AS odds, max(epoch_ms(l_shipdate)) AS ms, family FROM lineitem JOIN slots ON slot = l_orderkey % 12 GROUP BY ALL),"
    " best AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY event, slot ORDER BY odds DESC, book) = 1)"
)


@query(f"""{_BEST_SQL}, f(a, b) AS (VALUES ('MATCH_TOTAL', 'TEAM_TOTAL'), ('ASIAN_TOTAL', 'MATCH_TOTAL'), ('ASIAN_TOTAL', 'TEAM_TOTAL'), ('DOUBLE_CHANCE', 'MATCH_RESULT'), ('BTTS', 'MATCH_TOTAL')),
    p AS (SELECT count(*) AS n FROM best x JOIN best y ON x.event = y.event AND x.slot < y.slot LEFT JOIN f ON f.a = least(x.family, y.family) AND f.b = greatest(x.family, y.family) WHERE x.family = y.family OR f.a IS NOT NULL)
    SELECT least(n, {CAP}) AS kept, n >= {CAP} AS capped FROM p""")
def candidate_capped(spark, sf_dir):
    """Whether the cap on candidates was reached."""
    keys = ["event", "slot_a", "slot_b"]
    kept = quotes.pairs(quotes.best_price(binding.quotes(spark, sf_dir))).select(*keys).limit(CAP)
    return kept.agg(F.count("*").alias("kept")).select("kept", (F.col("kept") >= CAP).alias("capped"))


@query(f"""{_BEST_SQL}, u AS (SELECT x.event, x.odds AS a, y.odds AS b, 1 / x.odds + 1 / y.odds AS total, least(x.ms, y.ms) AS oldest, x.book AS ba, y.book AS bb FROM best x JOIN best y ON x.event = y.event AND x.slot = 0 AND y.slot = 1)
    SELECT 'episode:' || event || ':SAME_MARKET_COMPLEMENT:s0+s1' AS episode_key, oldest + {MAX_AGE_MS} AS expires_ms, round(100 / a / total * a, 6) AS return_a, round(100 / b / total * b, 6) AS return_b, round(100 * (1 / total - 1), 6) AS profit FROM u WHERE total < 1 AND ba <> bb""")
def opportunity_build(spark, sf_dir):
    """Stored opportunities: key, expiry by the oldest price, what each leg returns, guaranteed profit."""
    total = 1 / F.col("odds_a") + 1 / F.col("odds_b")
    found = binding.quotes(spark, sf_dir).where(F.col("slot").isin(0, 1))
    rows = quotes.pairs(quotes.best_price(found)).where((F.col("slot_a") == 0) & (F.col("slot_b") == 1) & (total < 1) & (F.col("book_a") != F.col("book_b")))
    ids = F.transform(F.array("slot_a", "slot_b"), lambda s: F.concat(F.lit("s"), s.cast("string")))
    returned = [F.round(100 / F.col(f"odds_{x}") / total * F.col(f"odds_{x}"), 6).alias(f"return_{x}") for x in "ab"]
    expires = F.least("observed_ms_a", "observed_ms_b") + MAX_AGE_MS
    return rows.select(candidates.episode_key(F.col("event"), quotes.structure(2), ids).alias("episode_key"), expires.alias("expires_ms"), *returned, F.round(100 * (1 / total - 1), 6).alias("profit"))


@query(f"{_BEST_SQL} SELECT event, CAST(slot AS INTEGER) AS slot, book, odds FROM q WHERE family = 'MATCH_TOTAL' AND contains(CAST(book AS VARCHAR), '7') AND odds >= 1.7")
def odds_filters(spark, sf_dir):
    """Prices by family, a part of the book's name and a least price."""
    q = binding.quotes(spark, sf_dir)
    return q.where((F.col("family") == "MATCH_TOTAL") & F.col("book").cast("string").contains("7") & (F.col("odds") >= 1.7)).select("event", "slot", "book", "odds")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, count(l_orderkey) AS legs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 42 GROUP BY ALL")
def event_by_id(spark, sf_dir):
    """One event with the number of its legs; the id reaches both scans."""
    legs = _lines(spark, sf_dir).where("l_orderkey = 42").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("legs"))
    return _orders(spark, sf_dir).where("o_orderkey = 42").join(legs, "o_orderkey", "left").select("o_orderkey", "o_custkey", "o_orderpriority", F.coalesce("legs", F.lit(0)).alias("legs"))


MARKET_LABELS = [
    "Goals Over/Under", "Total Goals O/U", "Home Team Goals O/U", "Away Team Total - 1st Half", "Home Asian Handicap", "Asian Handicap (Visitors)", "Asian Total", "Asian Team Total Hosts",
    "1X2", "1 x 2", "Match Result", "Three-Way - 2nd half", "Both Teams to Score", "BTTS first half", "Total Corners", "Yellow Cards", "Shots O/U", "Draw No Bet", "Anytime Goalscorer",
    "Correct Score", "Double-Chance", "Hcap", "Extra Time Total Goals", "Outright Winner", "Totál Góals", "Corner kicks", "Team overtime", None,
]
MARKET_KEYS = ["none", "none", "totals", "none", "h2h_first", "none", "team_home"]
REGISTRY = [("odds", "totals", "MATCH_TOTAL", "FULL_MATCH", None, None), ("odds", "h2h_first", "MATCH_RESULT", "FIRST_HALF", None, None), ("odds", "team_home", "TEAM_TOTAL", "FULL_MATCH", "HOME", None)]


@query(rf"""WITH {_SPEC_SQL}, d AS (SELECT l_orderkey, l_linenumber, {_pick_sql(MARKET_KEYS, 'l_partkey')} AS key,
      {_pick_sql(MARKET_LABELS, 'l_orderkey')} || CASE l_linenumber % 4 WHEN 0 THEN ' 2.5' WHEN 1 THEN ' -0,75' ELSE '' END AS label, CASE l_suppkey % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '3.5' END AS stated FROM lineitem),
    t AS (SELECT *, trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', ' ', 'g')) AS x, replace(regexp_extract_all(label, '-?[0-9]+([.,][0-9]+)?')[-1], ',', '.') AS own FROM d),
    w AS (SELECT *, string_split(x, ' ') AS ws, regexp_matches(x, 'total|over|under|o u|goals') AS totals FROM t),
    c AS (SELECT *, CASE WHEN key = 'totals' THEN 'MATCH_TOTAL' WHEN key = 'h2h_first' THEN 'MATCH_RESULT' WHEN key = 'team_home' THEN 'TEAM_TOTAL' WHEN x IS NULL THEN '!unknown key and no label'
        WHEN contains(x, 'double chance') THEN 'DOUBLE_CHANCE' WHEN contains(x, 'correct score') THEN 'EXACT_SCORE' WHEN regexp_matches(x, 'both teams to score|btts') THEN 'BTTS'
        WHEN contains(x, 'draw no bet') THEN '!draw no bet is intentionally unmapped' WHEN contains(x, 'goalscorer') THEN '!player markets have no family' WHEN 'corners' IN ws THEN 'CORNERS' WHEN 'cards' IN ws THEN 'CARDS' WHEN 'shots' IN ws THEN '!shots have no family'
        WHEN 'asian' IN ws AND 'handicap' IN ws THEN 'ASIAN_HANDICAP' WHEN 'asian' IN ws AND 'team' IN ws THEN 'TEAM_ASIAN_TOTAL' WHEN 'asian' IN ws AND totals THEN 'ASIAN_TOTAL' WHEN 'team' IN ws AND totals THEN 'TEAM_TOTAL'
        WHEN contains(x, 'hcap') THEN 'ASIAN_HANDICAP' WHEN totals THEN 'MATCH_TOTAL' WHEN replace(x, ' ', '') = '1x2' OR regexp_matches(x, 'match result|three way') THEN 'MATCH_RESULT' ELSE '!no rule fits the label' END AS found FROM w),
    f AS (SELECT *, found[1] <> '!' AS matched, CASE WHEN found[1] = '!' THEN found[2:] END AS reason, CASE WHEN found[1] <> '!' THEN found END AS family, key <> 'none' AS hit,
        CASE WHEN key = 'team_home' THEN 'HOME' WHEN 'home' IN ws OR 'hosts' IN ws THEN 'HOME' WHEN 'visitors' IN ws OR 'away' IN ws THEN 'AWAY' END AS side FROM c),
    g AS (SELECT f.*, takes_p, takes_l, type, CASE WHEN takes_l THEN coalesce(own, stated) END AS line, CASE WHEN takes_p THEN side END AS participant FROM f LEFT JOIN spec USING (family))
    SELECT l_orderkey, l_linenumber, matched, reason, family, type AS market_type, participant, line, CASE WHEN matched THEN CASE WHEN hit THEN 'key' ELSE 'label' END END AS via,
      CASE WHEN matched THEN CASE WHEN key = 'h2h_first' THEN 'FIRST_HALF' WHEN hit THEN 'FULL_MATCH' WHEN contains(x, 'extra time') THEN 'EXTRA_TIME' WHEN regexp_matches(x, '(1st|first) half') THEN 'FIRST_HALF' WHEN contains(x, '2nd half') THEN 'SECOND_HALF' ELSE 'FULL_MATCH' END END AS period,
      CASE WHEN matched THEN concat_ws(',', CASE WHEN takes_l AND line IS NULL THEN 'line' END, CASE WHEN takes_p AND participant IS NULL THEN 'participant' END) END AS problems FROM g""")
def label_normalize(spark, sf_dir):
    """Market identity of labels, keys and outcomes as a provider sends them, or why there is none."""
    suffix = F.when(F.col("l_linenumber") % 4 == 0, " 2.5").when(F.col("l_linenumber") % 4 == 1, " -0,75").otherwise("")
    stated = lambda *pairs: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).cast("string").alias("point")) for n, p in pairs))
    outcomes = F.when(F.col("l_suppkey") % 3 == 0, stated(("Over 1,5", None), ("Under 1.5", None))).when(F.col("l_suppkey") % 3 == 1, stated(("A", "-3.5"), ("B", "+3.5"), ("C 3.5", None)))
    label, key = F.concat(_pick(MARKET_LABELS, F.col("l_orderkey")), suffix), _pick(MARKET_KEYS, F.col("l_partkey"))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lit("odds").alias("provider"), key.alias("key"), label.alias("label"), outcomes.alias("outcomes"))
    found = labels.normalize_markets(rows, spark.createDataFrame(REGISTRY, labels.KEY_SCHEMA))
    return found.select("l_orderkey", "l_linenumber", "matched", "reason", "family", "market_type", "participant", "line", "via", "period", F.array_join("problems", ",").alias("problems"))


SELECTIONS = [
    ("MATCH_TOTAL", "FIRST_HALF", "OVER", None, 50), ("ASIAN_TOTAL", "SECOND_HALF", "UNDER", None, 125), ("TEAM_ASIAN_TOTAL", "FULL_MATCH", "OVER", "AWAY", 175), ("TEAM_TOTAL", "FULL_MATCH", "UNDER", None, 150),
    ("CORNERS", "FULL_MATCH", "OVER", None, 950), ("CARDS", "FULL_MATCH", "UNDER", None, 400), ("ASIAN_HANDICAP", "SECOND_HALF", "AWAY", None, -25), ("ASIAN_HANDICAP", "FULL_MATCH", "DRAW", None, 0),
    ("MATCH_RESULT", "EXTRA_TIME", "DRAW", None, None), ("DOUBLE_CHANCE", "FIRST_HALF", "AWAY_OR_DRAW", None, None), ("BTTS", "SECOND_HALF", "BTTS_YES", None, None), ("EXACT_SCORE", "PENALTIES", "5-4", None, None),
    ("CARDS", "FULL_MATCH", "OVER", None, None), ("OUTRIGHT", "FULL_MATCH", "HOME", None, None), ("MATCH_RESULT", "FULL_MATCH", "OVER", None, None), ("ASIAN_HANDICAP", "FIRST_HALF", "HOME", "HOME", -75), ("TEAM_TOTAL", "SECOND_HALF", "UNDER", "HOME", 100),
]
ENDINGS = ["FINISHED", "FINISHED", "ABANDONED", "FINISHED", "SCHEDULED", "POSTPONED", "FINISHED"]
_SELECTION_SQL = "sel(n, family, period, outcome, participant, line_c) AS (VALUES " + ", ".join(str((i, *s)).replace("None", "NULL") for i, s in enumerate(SELECTIONS)) + ")"


@query(f"""WITH {_SELECTION_SQL}, m AS (SELECT l_orderkey, l_linenumber, l_partkey % {len(SELECTIONS)} AS n, {_pick_sql(ENDINGS, 'l_orderkey')} AS status, {{'h': l_orderkey % 5, 'a': l_partkey % 4}} AS ft,
        CASE WHEN l_orderkey % 6 > 0 THEN {{'h': least(l_orderkey % 5, 1), 'a': least(l_partkey % 4, 1)}} END AS fh, CASE WHEN l_orderkey % 10 = 0 THEN {{'h': 3, 'a': 1}} END AS sh, CASE WHEN l_suppkey % 3 = 0 THEN {{'h': 1, 'a': l_linenumber % 2}} END AS et,
        CASE WHEN l_suppkey % 2 = 0 THEN {{'h': 5, 'a': 3 + l_linenumber % 2}} END AS pen, CASE WHEN l_suppkey % 5 > 0 THEN {{'h': l_suppkey % 9, 'a': l_orderkey % 7}} END AS corners, CASE WHEN l_suppkey % 4 > 0 THEN {{'h': l_suppkey % 4, 'a': l_orderkey % 5}} END AS cards FROM lineitem),
    s AS (SELECT m.*, sel.* EXCLUDE (n), CASE family WHEN 'CORNERS' THEN corners WHEN 'CARDS' THEN cards ELSE CASE period WHEN 'FULL_MATCH' THEN ft WHEN 'FIRST_HALF' THEN fh WHEN 'EXTRA_TIME' THEN et WHEN 'PENALTIES' THEN pen
        ELSE coalesce(sh, CASE WHEN fh IS NOT NULL THEN {{'h': ft.h - fh.h, 'a': ft.a - fh.a}} END) END END AS g FROM m JOIN sel USING (n)),
    x AS (SELECT *, g.h - g.a AS margin, 100 * CASE WHEN family LIKE 'TEAM%' THEN CASE participant WHEN 'HOME' THEN g.h WHEN 'AWAY' THEN g.a END ELSE g.h + g.a END AS actual FROM s),
    y AS (SELECT *, CASE WHEN family = 'ASIAN_HANDICAP' THEN CASE outcome WHEN 'HOME' THEN 100 * margin + line_c WHEN 'AWAY' THEN line_c - 100 * margin END ELSE CASE outcome WHEN 'OVER' THEN actual - line_c WHEN 'UNDER' THEN line_c - actual END END AS lead,
        CASE outcome WHEN 'HOME' THEN margin > 0 WHEN 'DRAW' THEN margin = 0 WHEN 'AWAY_OR_DRAW' THEN margin <= 0 WHEN 'BTTS_YES' THEN g.h > 0 AND g.a > 0 WHEN '5-4' THEN g.h = 5 AND g.a = 4 END AS good FROM x),
    z AS (SELECT *, CASE WHEN line_c % 50 <> 0 THEN [lead - 25, lead + 25] ELSE [lead, lead] END AS parts, family IN ('MATCH_RESULT', 'DOUBLE_CHANCE', 'BTTS', 'EXACT_SCORE') AS plain FROM y),
    r AS (SELECT *, CASE WHEN status IN ('ABANDONED', 'POSTPONED') THEN 'VOID' WHEN status <> 'FINISHED' OR family = 'OUTRIGHT' THEN NULL WHEN plain THEN CASE WHEN good THEN 'FULL_WIN' WHEN NOT good THEN 'FULL_LOSS' END WHEN lead IS NULL THEN NULL
        WHEN list_min(parts) > 0 THEN 'FULL_WIN' WHEN list_max(parts) < 0 THEN 'FULL_LOSS' WHEN list_max(parts) > 0 THEN 'HALF_WIN' WHEN list_min(parts) < 0 THEN 'HALF_LOSS' ELSE 'PUSH' END AS result FROM z)
    SELECT l_orderkey, l_linenumber, result, CASE WHEN result IS NOT NULL THEN NULL WHEN status <> 'FINISHED' THEN 'not finished' WHEN family = 'OUTRIGHT' THEN 'no rule' WHEN g IS NULL THEN 'no score' WHEN family = 'TEAM_TOTAL' AND participant IS NULL THEN 'no participant'
      WHEN family = 'CARDS' AND line_c IS NULL THEN 'no line' ELSE 'outcome' END AS reason FROM r""")
def settle_periods(spark, sf_dir):
    """Selections of every family settled in their own period, by goals, corners or cards, or why they can't be."""
    k, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    score = lambda home, away: F.struct(home.cast("int").alias("home"), away.cast("int").alias("away"))
    scores = {
        "full": score(k % 5, p % 4), "first": F.when(k % 6 > 0, score(F.least(k % 5, F.lit(1)), F.least(p % 4, F.lit(1)))), "second": F.when(k % 10 == 0, score(F.lit(3), F.lit(1))), "extra": F.when(s % 3 == 0, score(F.lit(1), n % 2)),
        "penalties": F.when(s % 2 == 0, score(F.lit(5), 3 + n % 2)), "corners": F.when(s % 5 > 0, score(s % 9, k % 7)), "cards": F.when(s % 4 > 0, score(s % 4, k % 5)),
    }
    kinds = spark.createDataFrame([(i, *x) for i, x in enumerate(SELECTIONS)], "n long, family string, period string, outcome string, participant string, line_c int")
    rows = _lines(spark, sf_dir).withColumn("n", p % len(SELECTIONS)).join(F.broadcast(kinds), "n")  # 17 rows
    found = settle.settle_periods(rows.select("l_orderkey", "l_linenumber", *kinds.columns[1:], _pick(ENDINGS, k).alias("status"), *(v.alias(c) for c, v in scores.items())))
    return found.select("l_orderkey", "l_linenumber", "result", "reason")


TEAM_NAMES = ["Over 1.5", "Under 1.5", "over", "Team  Alpha", "U", "Under 2,5", "maybe 3", "Under .5", " team beta", "Over -0.5", "o 2"]
TEAM_POINTS = [None, "1.5", "-0.25", "x", None]


@query(rf"""WITH o AS (SELECT l_orderkey, l_linenumber, 'b' || l_partkey % 3 AS book, {_pick_sql(TEAM_NAMES, 'l_orderkey')} AS name, {_pick_sql(TEAM_POINTS, 'l_partkey')} AS point,
      {_pick_sql(['team_totals_home', 'totals', 'team_totals_away'], 'l_suppkey')} AS key, (l_linenumber - 1) * 0.5 + 0.75 AS price FROM lineitem),
    p AS (SELECT *, CASE WHEN name = 'Team  Alpha' THEN 'HOME' WHEN name = ' team beta' THEN 'AWAY' WHEN key = 'team_totals_home' THEN 'HOME' ELSE 'AWAY' END AS who, CASE WHEN name ILIKE 'over%' THEN 'OVER' WHEN name ILIKE 'under%' OR name = 'U' THEN 'UNDER' END AS side,
      coalesce(CASE WHEN regexp_full_match(point, '-?[0-9]+(\.[0-9]+)?') THEN point END, nullif(replace(regexp_extract(trim(name), '(^| )(-?[0-9]+([.,][0-9]+)?)$', 2), ',', '.'), '')) AS line FROM o WHERE key <> 'totals')
    SELECT l_orderkey, l_linenumber, key || '::' || who || '::' || line AS market_id, CASE WHEN price > 1 THEN side END AS outcome, CASE WHEN price <= 1 OR side IS NULL THEN book || ':' || key || ':' || name END AS skip FROM p WHERE line IS NOT NULL""")
def team_total_split(spark, sf_dir):
    """Team totals of one provider market as markets of their own, and what is left out."""
    columns = {
        "book": F.concat(F.lit("b"), (F.col("l_partkey") % 3).cast("string")), "name": _pick(TEAM_NAMES, F.col("l_orderkey")), "point": _pick(TEAM_POINTS, F.col("l_partkey")), "home_team": F.lit("team alpha"), "away_team": F.lit("Team Beta"),
        "key": _pick(["team_totals_home", "totals", "team_totals_away"], F.col("l_suppkey")), "price": (F.col("l_linenumber") - 1) * 0.5 + 0.75,
    }
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *(v.alias(c) for c, v in columns.items()))
    return market.split_team_totals(rows).select("l_orderkey", "l_linenumber", "market_id", "outcome", "skip")
