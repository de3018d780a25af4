"""Folding of stored events against a plain fold over all roots, and pruning against single faults."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import candidates, reconcile, reports
from quoteloom.sources.versions import Versions

HOUR = 3_600_000
SCHEMA = "id long, provider string, home string, away string, competition string, start_ms long, created_ms long"


def plain(events):
    """id to (winner, score, uncertain id, uncertain score, members): every event against every root before it."""
    trust = {"odds-api": 0, "parlay-api": 1}
    names = lambda e: [e[1]] if isinstance(e[1], str) else e[1]
    order = lambda e: (min((trust.get(p, 2) for p in names(e)), default=2), -1 if e[6] is None else e[6], e[0])
    roots, out = [], {}
    for e in sorted(events, key=order):
        best = near = None
        for r in roots:
            if not frozenset(names(r)).isdisjoint(names(e)) or None in (e[2], e[3], e[5], r[5]) or r[2:4] != e[2:4]:
                continue
            score = 0.5 + 0.3 * (abs(r[5] - e[5]) <= 2 * HOUR) + (0 if None in (r[4], e[4]) else 0.2 if r[4] == e[4] else -0.2)
            score = round(score, 3)
            if score >= 0.8:
                best = (r[0], score) if best is None or score > best[1] else best
            else:
                near = (r[0], score) if near is None or score > near[1] else near
        if best:
            out[e[0]] = (*best, None, None)
        else:
            roots.append(e)
            out[e[0]] = (e[0], None, *(near or (None, None)))
    size = {}
    for w, *_ in out.values():
        size[w] = size.get(w, 0) + 1
    return {i: (*x, size[x[0]]) for i, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_plain(spark, seed):
    rng = random.Random(seed)
    event = lambda i: (i, rng.choice(["odds-api", "parlay-api", "x", "y"]), rng.choice("ab"), rng.choice("pq"), rng.choice(["m", "n", None]), rng.randrange(-30, 60) * HOUR // 2, rng.choice([None, 1, 2, 3]))
    events = [event(i) for i in range(120)] + [(200, "x", None, "p", "m", 0, 1), (201, "y", None, "p", "m", 0, 1), (202, "x", "a", "p", "m", None, 1)]
    # far and near ones of other competitions
    events += [(300, "odds-api", "f", "f", "m", 0, 1), (301, "parlay-api", "f", "f", "n", 50 * HOUR, 1), (302, "x", "f", "f", "o", HOUR, 1)]
    got = {r["id"]: tuple(r)[1:] for r in reconcile.fold_events(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == plain(events)
    assert {s for _, s, _, _, _ in got.values()} >= {0.8, 1.0, None} and {s for *_, s, _ in got.values()} >= {0.3, 0.5, 0.6, 0.7}


@pytest.mark.parametrize("seed", [4, 5])
def test_fold_of_events_with_several_sources(spark, seed):
    """Events that share a provider are never one; the most trusted provider decides the order."""
    rng = random.Random(seed)
    names = ["odds-api", "parlay-api", "x", "y"]
    events = [(i, rng.sample(names, rng.choice([0, 1, 1, 2, 3])), rng.choice("ab"), "p", rng.choice(["m", "n", None]), rng.randrange(-30, 60) * HOUR // 2, rng.choice([None, 1, 2, 3])) for i in range(150)]
    rows = spark.createDataFrame(events, SCHEMA.replace("provider string", "providers array<string>"))
    got = {r["id"]: tuple(r)[1:] for r in reconcile.fold_events(rows).collect()}
    assert got == plain(events)


def test_fold_of_one_large_island(spark):
    """Twice the events of an island take about twice the time: an event meets the starts near it, not all roots."""
    took = []
    for n in (40_000, 80_000):
        roots, began = reconcile.Roots(2 * HOUR), time.process_time()
        for i in range(n):
            start, providers = i * 60_000, frozenset([["odds-api", "x"][i % 2]])
            best, _ = roots.held_against(providers, "m" if i % 3 else "n", start)
            if best is None:
                roots.add(i, providers, "m" if i % 3 else "n", start)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0]
    events = spark.range(24_000).selectExpr("id", "if(id % 2 = 0, 'odds-api', 'x') provider", "'a' home", "'b' away", "'m' competition", "id * 60000 start_ms", "id created_ms")
    began = time.time()
    assert reconcile.fold_events(events).count() == 24_000 and time.time() - began < 10


def test_fold_of_no_events(spark):
    assert reconcile.fold_events(spark.createDataFrame([], SCHEMA)).collect() == []


def test_merge_rows(spark):
    plan = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, winner_id long")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (4, "a")], "event long, k string")
    assert {tuple(r) for r in reconcile.merge_rows(rows, plan, "event", ["k"]).collect()} == {(1, 3, 2, 2), (4, 1, 0, 0)}


LEG = dict(event=1, period="FULL_MATCH", family="MATCH_TOTAL", participant=None, line_c=250, outcome="OVER", book=1, odds=2.1, suspended=False, confidence=None, observed_ms=100)
OTHER = LEG | dict(outcome="UNDER", book=2)
LEG_TYPE = "struct<event:long,period:string,family:string,participant:string,line_c:int,outcome:string,book:long,odds:double,suspended:boolean,confidence:double,observed_ms:long>"


@pytest.mark.parametrize("legs,want", [
    ([LEG, OTHER], []),
    ([], ["CANDIDATE_SIZE"]),
    ([LEG], ["CANDIDATE_SIZE"]),
    ([LEG, OTHER | dict(event=2)], ["EVENT_MISMATCH"]),
    ([LEG, OTHER | dict(period="FIRST_HALF")], ["PERIOD_MISMATCH"]),
    ([LEG, LEG | dict(book=3)], ["DUPLICATE_SELECTION"]),
    ([LEG, OTHER | dict(book=1)], ["SAME_BOOKMAKER"]),
    ([LEG, OTHER | dict(odds=float("nan"))], ["INVALID_ODDS"]),
    ([LEG, OTHER | dict(odds=None)], ["INVALID_ODDS"]),
    ([LEG, OTHER | dict(odds=1.0)], ["INVALID_ODDS", "PRICE_PREFILTER"]),
    ([LEG, OTHER | dict(odds=1.5)], ["PRICE_PREFILTER"]),
    ([LEG, OTHER | dict(suspended=True)], ["SUSPENDED"]),
    ([LEG, OTHER | dict(suspended=None, observed_ms=None)], []),
    ([LEG, OTHER | dict(confidence=0.79)], ["EVENT_UNCERTAIN"]),
    ([LEG, OTHER | dict(confidence=0.8)], []),
    ([LEG, OTHER | dict(observed_ms=89)], ["STALE_ODDS"]),
    ([LEG, OTHER | dict(family="BTTS", line_c=None, outcome="BTTS_NO")], []),
    ([LEG, OTHER | dict(family="MATCH_RESULT", line_c=None, outcome="HOME")], ["INCOMPATIBLE_MARKET"]),
])
def test_prune_reasons(spark, legs, want):
    names = list(LEG)
    rows = spark.createDataFrame([([tuple(x[n] for n in names) for x in legs],)], f"legs array<{LEG_TYPE}>")
    reasons = candidates.prune(F.col("legs"), F.lit(1), F.lit("FULL_MATCH"), now_ms=100, max_age_ms=10)
    got = rows.select(reasons.alias("r"), candidates.rejections(reasons).alias("x")).first()
    assert got["r"] == want and got["x"] == sorted({candidates.REJECTIONS[w] for w in want})


def test_broken_cursors(spark):
    rows = spark.createDataFrame([("",), ("%%%",), ("abcde",), ("bm90IGpzb24",), ("eyJ2IjoiMSJ9",), (None,), ("eyJ2IjoiMSIsImlkIjoiMiJ9",)], "c string")
    assert [r[0] and tuple(r[0]) for r in rows.select(reports.decode_cursor(F.col("c"))).collect()] == [None] * 6 + [("1", "2")]


def test_merge_is_applied_once(spark, tmp_path):
    """All rows stay or are conflicts; an attempt that died and a retry leave one version."""
    rng = random.Random(8)
    plan = [(i, i if i % 4 == 0 else i - i % 4) for i in range(40)]
    rows = [(rng.randrange(40), rng.choice(["a", "b", None]), rng.randrange(3)) for _ in range(200)]
    frames = spark.createDataFrame(plan, "id long, winner_id long"), spark.createDataFrame(rows, "event long, k string, x int")
    winner, groups = dict(plan), {}
    for event, k, x in rows:
        groups.setdefault((winner[event], k), []).append((event != winner[event], event, x))
    want = sorted((w, k, *[(e, m, x) for m, e, x in sorted(g)][0]) for (w, k), g in groups.items() if k) + sorted((w, None, *[(e, m, x) for m, e, x in sorted(g)][0]) for (w, k), g in groups.items() if not k)
    lost = [(e, k, x, w, sorted(g)[0][1]) for (w, k), g in groups.items() for _, e, x in sorted(g)[1:]]
    versions = Versions(spark, f"file://{tmp_path}/merge")
    versions.write("rows", 3, frames[1].limit(5))  # died before its commit
    assert reconcile.apply_merge(versions, 3, frames[0], {"rows": (frames[1], "event", ["k"])})
    assert not reconcile.apply_merge(versions, 3, frames[0], {"rows": (frames[1].limit(1), "event", ["k"])})
    assert versions.committed() == [3] and versions.last_before(3) is None and versions.last_before(9) == 3
    assert sorted(map(tuple, versions.read("rows", 3).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, versions.read("rows_conflicts", 3).collect()), key=repr) == sorted(lost, key=repr)
