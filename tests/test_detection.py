"""The detection run against plain Python, and its stream against a run after another."""

import itertools

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import detection
from quoteloom.plans import detection as plans
from quoteloom.sources import binding
from quoteloom.sources.versions import Versions
from quoteloom.streaming import detect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def priced(spark):
    """The smallest table's prices, with some sources down."""
    rows = binding.priced(spark, SF_DIR)
    return spark.createDataFrame(rows.withColumn("status", F.when(F.col("book") % 4 == 0, "DOWN").otherwise(F.col("status"))).collect(), rows.schema)


def test_selected(spark, priced):
    groups = {}
    for r in priced.collect():
        groups.setdefault((r["event"], r["period"]), {}).setdefault(r["slot"], []).append(r)
    up = lambda r: r["status"] in (None, "HEALTHY", "DEGRADED")
    want = set()
    for group, slots in groups.items():
        taken = set()
        for slot in sorted(slots):
            rows = sorted(slots[slot], key=lambda r: r["leg_id"])
            best = max((r["odds"] for r in rows if up(r)), default=None) or max(r["odds"] for r in rows)
            ties = sorted((r for r in rows if r["odds"] == best), key=lambda r: not up(r))
            pick = next((r for r in ties if r["book"] not in taken), ties[0])
            taken.add(pick["book"])
            want.add((*group, slot, pick["leg_id"]))
    got = detection.selected(priced).selectExpr("event", "period", "explode(legs) l").selectExpr("event", "period", "l.slot", "l.leg_id")
    assert {tuple(r) for r in got.collect()} == want
    assert {up(r) for r in priced.collect()} == {True, False}


def leg(slot, book, odds, event=1, period="FULL_TIME", observed=1000, status="HEALTHY", confidence=0.9):
    _, family, market, participant, line_c, outcome, _ = binding.SLOTS[slot]
    return (f"{slot}:{book}", event, period, slot, book, family, market, participant, line_c, outcome, odds, observed, status, confidence, False)


SCHEMA = (
    "leg_id string, event long, period string, slot int, book long, family string, market_type string, participant string, line_c int, outcome string, "
    "odds double, observed_ms long, status string, confidence double, suspended boolean"
)


def found(spark, legs, **policy):
    policy = detection.Policy(**({"now_ms": 2000} | policy))
    return detection.opportunities(detection.scanned(spark.createDataFrame(legs, SCHEMA), binding.slots(spark), policy), policy)


@pytest.mark.parametrize(
    "change,status,rejection",
    [
        ({}, "VERIFIED_ARB", None),
        ({"confidence": None}, "THEORETICAL_ARB", "INSUFFICIENT_PROVENANCE"),
        ({"status": None}, "THEORETICAL_ARB", "INSUFFICIENT_PROVENANCE"),
        ({"observed": -20_000}, "STALE", "STALE_ODDS"),
        ({"status": "DOWN"}, "REJECTED", "PROVIDER_UNAVAILABLE"),
    ],
)
def test_ladder(spark, change, status, rejection):
    rows = found(spark, [leg(0, 1, 2.2, **change), leg(1, 2, 2.2)]).collect()
    assert [(r["status"], r["rejection"]) for r in rows] == [(status, rejection)]
    assert rows[0]["stakes"] == pytest.approx([50, 50]) and rows[0]["profit"] == pytest.approx(10) and rows[0]["expires_ms"] == 2000 - (2000 - min(change.get("observed", 1000), 1000)) + 15_000


def test_spread_confidence_and_groups(spark):
    apart = found(spark, [leg(0, 1, 2.2, observed=1000), leg(1, 2, 2.2, observed=1999)], max_spread_ms=500).collect()
    assert [(r["status"], r["rejection"]) for r in apart] == [("REJECTED", "CROSS_SOURCE_TIMESTAMP_SPREAD")]
    assert found(spark, [leg(0, 1, 2.2, confidence=0.7), leg(1, 2, 2.2)]).collect() == []  # pruned
    assert found(spark, [leg(0, 1, 2.2), leg(1, 2, 2.2, period="FIRST_HALF")]).collect() == []  # other groups
    assert found(spark, [leg(0, 1, 2.2), leg(1, 1, 2.2)]).collect() == []  # one book
    healthy = found(spark, [leg(0, 1, 2.2), leg(0, 3, 9.0, status="DOWN"), leg(1, 2, 2.2)]).collect()
    assert [r["min_return"] for r in healthy] == pytest.approx([110])
    assert found(spark, []).collect() == []


def test_stakes_guarantee_the_return(spark, priced):
    scans = detection.scanned(priced, binding.slots(spark), plans.POLICY)
    vectors = {tuple(r["slots"]): r["vectors"] for r in detection.verdicts(binding.slots(spark)).collect()}
    pay = {2: lambda o: o, 1: lambda o: (o + 1) / 2, 0: lambda o: 1.0, -1: lambda o: 0.5, -2: lambda o: 0.0}
    rows = detection.opportunities(scans, plans.POLICY).collect()
    assert {len(r["slots"]) for r in rows} == {2, 3}
    for r in rows:
        returns = [sum(pay[v](x["odds"]) * stake for v, x, stake in zip(state, r["legs"], r["stakes"])) for state in vectors[tuple(r["slots"])]]
        assert sum(r["stakes"]) == pytest.approx(100) and min(returns) == pytest.approx(r["min_return"], abs=1e-6) and r["profit"] > 0


def test_statuses_of_a_run(spark):
    rows = plans.detection_run(spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r["status"] for r in rows} == {"VERIFIED_ARB", "THEORETICAL_ARB", "STALE", "REJECTED"}


def tables(versions, number):
    return {name: sorted(map(str, versions.read(name, number).collect())) for name in ("prices", "opportunities", "legs", "episodes")}


def test_runs_are_repeatable(spark, priced, tmp_path):
    """A repeated batch changes nothing, nor does one that died before its commit; runs in turn equal the stream."""
    cuts = [0, 883_612_800_000, 946_684_800_000, 2_000_000_000_000]
    batches = [priced.where(f"observed_ms > {a} and observed_ms <= {b}") for a, b in itertools.pairwise(cuts)]
    slots, one = binding.slots(spark), Versions(spark, f"file://{tmp_path}/one")
    seen = []
    for number, batch in enumerate(batches):
        if number == 1:  # an attempt that dies after two tables
            one.write("prices", number, batch.limit(3))
            one.write("opportunities", number, one.read("opportunities", 0).limit(1))
            assert one.committed() == [0]
        assert detect.run_batch(batch, number, one, slots, plans.POLICY)
        seen.append(tables(one, number))
        assert not detect.run_batch(batch, number, one, slots, plans.POLICY) and tables(one, number) == seen[-1]
    assert one.committed() == [0, 1, 2] and all(x["opportunities"] and x["episodes"] for x in seen)
    # the fold in plain Python
    episodes = {}
    for number in range(3):
        now = max(r["observed_ms"] for r in priced.where(f"observed_ms <= {cuts[number + 1]}").collect())
        status = {}
        for r in one.read("opportunities", number).collect():
            status[r["key"]] = min(status.get(r["key"], r["status"]), r["status"])
        for key in status:
            old = episodes.get(key)
            episodes[key] = (status[key], now if old is None else old[1], now, 1 if old is None else old[3] + 1, None)
        for key, old in episodes.items():
            if key not in status and old[4] is None and old[2] < now:
                episodes[key] = (*old[:4], now)
    assert {r["key"]: (r["status"], r["first_ms"], r["last_ms"], r["detected"], r["disappeared_ms"]) for r in one.read("episodes", 2).collect()} == episodes
    assert any(x[4] for x in episodes.values()) and any(x[3] == 3 for x in episodes.values())
    # the same prices as a stream of three files, one a batch
    for number, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(priced.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = detect.detect(source, f"file://{tmp_path}/two", slots, plans.POLICY, f"file://{tmp_path}/checkpoint")
    query.awaitTermination(300)
    two = Versions(spark, f"file://{tmp_path}/two")
    assert two.committed()[-1] == max(two.committed()) and tables(two, two.committed()[-1])["prices"] == seen[-1]["prices"]


def test_solver_gets_no_legs_and_prices_are_shuffled_once(spark):
    """Candidates are neither exploded from arrays of legs nor sent whole to Python; all price rows move once, those of an event together."""
    scans = detection.scanned(binding.priced(spark, SF_DIR), binding.slots(spark), plans.POLICY)
    plan = scans._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Generate explode(all" not in plan and "ArrowEvalPython" in plan
    rows = detection.selected(binding.priced(spark, SF_DIR))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert sum("Exchange hashpartitioning(event" in line for line in plan.splitlines()) == 2  # prices and parts


def test_combinations_are_those_of_legs_in_place(spark, priced):
    """Candidates against a walk over each group's legs, with the reasons of the general rules."""
    from quoteloom.operators import candidates, quotes

    families = {s[0]: s[1] for s in binding.SLOTS}
    fits = lambda a, b: families[a] == families[b] or tuple(sorted((families[a], families[b]))) in quotes.COMPATIBLE
    rows = priced.withColumn("suspended", F.col("book") % 3 == 0)
    want = set()
    for r in detection.selected(rows).collect():
        slots = [x["slot"] for x in r["legs"]]
        for n in (2, 3):
            want |= {(r["event"], r["period"], c) for c in itertools.combinations(slots, n) if all(fits(a, b) for a, b in itertools.combinations(c, 2))}
    found = detection.scanned(rows, binding.slots(spark), plans.POLICY)
    full = F.transform("legs", lambda x: F.struct("event", "period", *(x[c].alias(c) for c in detection.LEG)))
    general = candidates.prune(full, F.col("event"), F.col("period"), plans.POLICY.now_ms)
    got = found.select("event", "period", "slots", "reasons", general.alias("general")).collect()
    assert len(got) == len(want) and {(r["event"], r["period"], tuple(r["slots"])) for r in got} == want
    assert all(r["reasons"] == r["general"] for r in got) and {x for r in got for x in r["reasons"]} >= {"SUSPENDED", "SAME_BOOKMAKER", "EVENT_UNCERTAIN"}


def test_opportunities_solve_once(spark, priced):
    """The filter on the solver's result solves nothing again, books are spread in one fold, and refuted combinations meet no prices."""
    scans = detection.scanned(priced, binding.slots(spark), plans.POLICY, only_open=True)
    found = detection.opportunities(scans, plans.POLICY)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("array_union(") == 1
    whole = detection.scanned(priced, binding.slots(spark), plans.POLICY)
    assert detection.opportunities(whole, plans.POLICY)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    columns = ["event", "period", "slots", "status", "best_return", "shares"]
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(scans) == text(whole.where("status in ('ARB', 'NO_ARB')")) and {r["status"] for r in scans.select("status").distinct().collect()} == {"ARB", "NO_ARB"}
