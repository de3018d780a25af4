"""Queries over halves, corners and cards, and stakes of any number of legs, each with its DuckDB SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joint
from ..sources import binding
from .oracles import _GOALS, _RESULT

QUERIES, SQL = {}, {}

LEG, TYPES = ["family", "period", "participant", "line_c", "outcome"], ["string", "string", "string", "int", "string"]
#: Selections of which one always wins: the result, corners and cards of a match.
EXHAUSTIVE = {"goals": [0, 1, 2], "corners": [12, 13], "cards": [15, 16]}

_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_SLOTS = "js(slot, family, period, participant, line_c, outcome, base) AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in binding.JOINT) + ")"
_BEST = f"""{_SLOTS}, jb AS (SELECT l_partkey AS event, CAST(slot AS INTEGER) AS slot, max(round(CAST(base AS DOUBLE) + l_discount * 4 + l_tax * 2, 2)) AS odds FROM lineitem JOIN js ON slot = l_orderkey % {len(binding.JOINT)} GROUP BY ALL)"""
# Results on the grids of each part; then, for a pair, the distinct results of each part, their product and its faults.
_JUDGED = f"""{_BEST},
dim AS (SELECT CAST(slot AS INTEGER) AS slot, CASE WHEN family IN ('CORNERS', 'CARDS') THEN 'MATCH_TOTAL' ELSE family END AS family, period, participant, line_c, outcome, lower(CASE WHEN family IN ('CORNERS', 'CARDS') THEN family ELSE 'goals' END) AS part,
  family || '|' || period || '|' || coalesce(participant, '-') AS metric, CASE WHEN line_c IS NOT NULL THEN CAST(ceil(abs(line_c) / 100.0) AS INTEGER) WHEN family = 'EXACT_SCORE' THEN 2 ELSE 1 END AS bound FROM js),
grid AS (SELECT * FROM range(13) h(h), range(13) a(a), range(13) x(fh), range(13) y(fa) WHERE fh <= h AND fa <= a),
cnt AS (SELECT 'goals' AS part, * FROM grid UNION ALL SELECT unnest(['corners', 'cards']), h, a, 0, 0 FROM range(24) h(h), range(24) a(a)),
ctd AS (SELECT dim.*, h, a, fh, fa, CASE WHEN dim.part = 'goals' AND period = 'FIRST_HALF' THEN fh WHEN dim.part = 'goals' AND period = 'SECOND_HALF' THEN h - fh ELSE h END AS home,
  CASE WHEN dim.part = 'goals' AND period = 'FIRST_HALF' THEN fa WHEN dim.part = 'goals' AND period = 'SECOND_HALF' THEN a - fa ELSE a END AS away FROM dim JOIN cnt ON cnt.part = dim.part WHERE period <> 'EXTRA_TIME'),
rs AS (SELECT slot, part, h, a, fh, fa, CAST({_RESULT} AS INTEGER) AS r FROM (SELECT *, {_GOALS} AS g FROM ctd)),
pr AS (SELECT x.slot AS slot_a, y.slot AS slot_b, x.part AS pa, y.part AS pb, x.metric = y.metric AS same, greatest(x.bound, y.bound) + 1 AS top,
  (x.part = 'goals' AND x.period LIKE '%HALF') OR (y.part = 'goals' AND y.period LIKE '%HALF') AS half FROM dim x JOIN dim y ON x.slot < y.slot WHERE x.period <> 'EXTRA_TIME' AND y.period <> 'EXTRA_TIME'),
lim AS (SELECT *, unnest(['goals', 'corners', 'cards']) AS part FROM pr),
cl AS (SELECT l.slot_a, l.slot_b, l.part, ra, rb, min(pos) AS pos FROM (
    SELECT l.*, x.r AS ra, y.r AS rb, [x.h, x.a, x.fh, x.fa] AS pos FROM lim l JOIN rs x ON x.slot = slot_a AND x.part = l.part JOIN rs y ON y.slot = slot_b AND y.part = l.part AND y.h = x.h AND y.a = x.a AND y.fh = x.fh AND y.fa = x.fa
    UNION ALL SELECT l.*, x.r, NULL, [x.h, x.a, x.fh, x.fa] FROM lim l JOIN rs x ON x.slot = slot_a AND x.part = l.part WHERE pb <> l.part
    UNION ALL SELECT l.*, NULL, y.r, [y.h, y.a, y.fh, y.fa] FROM lim l JOIN rs y ON y.slot = slot_b AND y.part = l.part WHERE pa <> l.part) l
  WHERE greatest(pos[1], pos[2]) <= greatest(2, top + CASE WHEN part = 'corners' THEN 10 ELSE 0 END) AND (half OR pos[3] + pos[4] = 0) GROUP BY ALL
  UNION ALL SELECT slot_a, slot_b, part, NULL, NULL, NULL FROM lim WHERE part NOT IN (pa, pb)),
st AS (SELECT slot_a, slot_b, same, half, coalesce(g.ra, c.ra, k.ra) AS ra, coalesce(g.rb, c.rb, k.rb) AS rb, g.pos AS gp, c.pos AS cp, k.pos AS kp
  FROM pr JOIN cl g USING (slot_a, slot_b) JOIN cl c USING (slot_a, slot_b) JOIN cl k USING (slot_a, slot_b) WHERE g.part = 'goals' AND c.part = 'corners' AND k.part = 'cards'),
fl AS (SELECT *, ra = -2 AND rb = -2 AS lost, ra > 0 AND rb > 0 AS two, ra <= 0 AND rb <= 0 AND NOT (ra = -2 AND rb = -2) AS gap,
  CASE WHEN gp IS NULL THEN '-' ELSE gp[1] || '-' || gp[2] || CASE WHEN half THEN '/' || gp[3] || '-' || gp[4] ELSE '' END END || '|' || coalesce(cp[1] || '-' || cp[2], '-') || '|' || coalesce(kp[1] || '-' || kp[2], '-') AS name FROM st),
jg AS (SELECT slot_a, slot_b, count(*) AS n_states, count(*) FILTER (two AND same) AS n_overlap, count(*) FILTER (two AND NOT same) AS n_cross, count(*) FILTER (lost) AS n_lost, count(*) FILTER (gap) AS n_gap,
  arg_min(name, (coalesce(gp, []), coalesce(cp, []), coalesce(kp, []))) FILTER (lost OR gap OR (two AND same)) AS evidence FROM fl GROUP BY ALL)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def judged_slots(spark, chosen) -> DataFrame:
    """slots (their numbers, joined by commas) and the verdict on each of some combinations of the joint selections."""
    legs = F.create_map(*(x for r in binding.JOINT for x in (F.lit(r[0]), F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(LEG, r[1:6], TYPES, strict=True))))))
    sets = spark.createDataFrame([(list(c),) for c in chosen], "slots array<int>")
    return joint.judged(sets.select(F.array_join("slots", ",").alias("set"), F.transform("slots", lambda x: legs[x]).alias("legs"))).withColumnRenamed("set", "slots")


@query(f"""WITH {_JUDGED}, ev AS (SELECT x.slot AS slot_a, y.slot AS slot_b, count(*) AS candidates FROM jb x JOIN jb y ON x.event = y.event AND x.slot < y.slot GROUP BY ALL)
    SELECT ev.*, coalesce(n_states, 0) AS n_states, coalesce(n_overlap, 0) AS n_overlap, coalesce(n_cross, 0) AS n_cross, coalesce(n_lost, 0) AS n_lost, coalesce(n_gap, 0) AS n_gap, evidence,
      CASE WHEN n_states IS NULL THEN 'UNKNOWN_SETTLEMENT' WHEN n_lost + n_overlap + n_gap = 0 THEN 'COVERED'
        ELSE concat_ws('+', CASE WHEN n_lost > 0 THEN 'BOTH_LOSS_STATE' END, CASE WHEN n_overlap > 0 THEN 'NON_EXCLUSIVE' END, CASE WHEN n_gap > 0 THEN 'NON_EXHAUSTIVE' END) END AS verdict
    FROM ev LEFT JOIN jg USING (slot_a, slot_b)""")
def coverage_verdicts_periods(spark, sf_dir):
    """Every pair of priced selections over halves, corners and cards: in how many events, and the verdict on its states."""
    groups = binding.joint_best(spark, sf_dir).groupBy("event").agg(F.collect_set("slot").alias("slots"))  # at most 24 an event
    first = groups.select("slots", F.explode("slots").alias("slot_a"))
    pairs = first.select("slot_a", F.explode(F.filter("slots", lambda x: x > F.col("slot_a"))).alias("slot_b"))
    counted = pairs.groupBy("slot_a", "slot_b").agg(F.count("*").alias("candidates"))
    found = judged_slots(spark, combinations(sorted(r[0] for r in binding.JOINT), 2))  # 276 pairs
    counts = ["n_states", "n_overlap", "n_cross", "n_lost", "n_gap"]
    return counted.withColumn("slots", F.concat_ws(",", "slot_a", "slot_b")).join(F.broadcast(found), "slots").select("slot_a", "slot_b", "candidates", *counts, "verdict", "evidence")


_GROUP = "CASE " + " ".join(f"WHEN slot IN ({', '.join(map(str, v))}) THEN {len(v)}" for v in EXHAUSTIVE.values()) + " END"
_PART = "CASE " + " ".join(f"WHEN slot IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in EXHAUSTIVE.items()) + " END"


# Parts are independent, so the least return of a split stake is the sum of its parts': the best is the best part alone.
@query(f"""WITH {_BEST}, lg AS (SELECT *, {_PART} AS part, {_GROUP} AS size FROM jb WHERE {_PART} IS NOT NULL),
    v AS (SELECT event, part, CASE WHEN count(*) = max(size) THEN 100 / sum(1 / odds) END AS worth, count(*) AS legs, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots FROM lg GROUP BY event, part)
  SELECT event, string_agg(slots, ',' ORDER BY CASE part WHEN 'goals' THEN 1 WHEN 'corners' THEN 2 ELSE 3 END) AS slots, CAST(sum(legs) AS BIGINT) AS legs, max(worth) IS NOT NULL AS covered,
    round(max(worth), 6) AS min_return, round(max(worth) - 100, 6) AS profit, coalesce(max(worth) > 100 + 1e-7, false) AS is_arb, CASE WHEN max(worth) IS NOT NULL THEN CAST(100 AS DOUBLE) END AS staked FROM v GROUP BY event""")
def maximin_stakes(spark, sf_dir):
    """Stakes of 1 to 7 legs of an event, its result, corners and cards: which sets are covered, and what they guarantee."""
    wanted = [x for slots in EXHAUSTIVE.values() for x in slots]
    legs = binding.joint_best(spark, sf_dir).where(F.col("slot").isin(wanted))
    groups = legs.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("slot", "odds"))).alias("legs"))  # at most 7 an event
    rows = groups.select("event", F.transform("legs", lambda x: x["slot"]).alias("slots"), F.transform("legs", lambda x: x["odds"]).alias("odds"))
    subsets = [c for n in range(1, len(wanted) + 1) for c in combinations(wanted, n)]
    found = judged_slots(spark, subsets).select("slots", "verdict", F.transform("states", lambda x: x["vector"]).alias("states"))
    named = rows.withColumn("slots", F.array_join("slots", ",")).join(F.broadcast(found), "slots")  # 127 sets
    covered = F.col("verdict") == "COVERED"
    staked = joint.staked(named.select("event", "slots", "odds", covered.alias("covered"), F.when(covered, F.col("states")).alias("vectors")))
    total = F.round(F.aggregate("stakes", F.lit(0.0), lambda a, x: a + x), 6)
    return staked.select("event", "slots", F.size("odds").cast("long").alias("legs"), "covered", F.round("min_return", 6).alias("min_return"), F.round("profit", 6).alias("profit"), "is_arb", total.alias("staked"))
