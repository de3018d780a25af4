"""Joint states against grids in plain Python, and stakes against vertices and a grid of shares."""

import itertools

import numpy as np
import pytest

from quoteloom.operators import coverage, joint

LEG = "struct<family: string, period: string, participant: string, line_c: int, outcome: string>"


def leg(family, outcome, line_c=None, period="FULL_MATCH", participant=None):
    return (family, period, participant, line_c, outcome)


OVER, UNDER = leg("MATCH_TOTAL", "OVER", 250), leg("MATCH_TOTAL", "UNDER", 250)
CASES = {
    "complement": ([OVER, UNDER], "COVERED"),
    "result": ([leg("MATCH_RESULT", o) for o in ("HOME", "DRAW", "AWAY")], "COVERED"),
    "double chance and result": ([leg("DOUBLE_CHANCE", "HOME_OR_DRAW"), leg("MATCH_RESULT", "AWAY")], "COVERED"),
    "three legs of two markets": ([leg("MATCH_RESULT", "HOME"), leg("MATCH_RESULT", "DRAW"), leg("DOUBLE_CHANCE", "HOME_OR_AWAY")], "COVERED"),
    "overlapping totals": ([leg("MATCH_TOTAL", "OVER", 1050), leg("MATCH_TOTAL", "UNDER", 1350)], "NON_EXCLUSIVE"),
    "team totals and total": ([leg("MATCH_TOTAL", "UNDER", 150), leg("TEAM_TOTAL", "OVER", 150, participant="HOME"), leg("TEAM_TOTAL", "OVER", 150, participant="AWAY")], "BOTH_LOSS_STATE"),
    "push of a whole line": ([leg("ASIAN_TOTAL", "OVER", 200), leg("ASIAN_TOTAL", "UNDER", 200)], "NON_EXHAUSTIVE"),
    "push of a handicap": ([leg("ASIAN_HANDICAP", "HOME", 100, participant="HOME"), leg("ASIAN_HANDICAP", "AWAY", -100, participant="AWAY")], "NON_EXHAUSTIVE"),
    "both lose": ([leg("TEAM_TOTAL", "OVER", 250, participant=p) for p in ("HOME", "AWAY")], "BOTH_LOSS_STATE"),
    "uncovered": ([leg("MATCH_TOTAL", "UNDER", 150), leg("MATCH_TOTAL", "OVER", 650)], "BOTH_LOSS_STATE"),
    "first half": ([leg("MATCH_TOTAL", "OVER", 150, "FIRST_HALF"), leg("MATCH_TOTAL", "UNDER", 150, "FIRST_HALF")], "COVERED"),
    "halves don't cover": ([leg("MATCH_TOTAL", "OVER", 150, "FIRST_HALF"), leg("MATCH_TOTAL", "UNDER", 150, "SECOND_HALF")], "BOTH_LOSS_STATE"),
    "half within the match": ([leg("MATCH_TOTAL", "OVER", 50, "FIRST_HALF"), leg("MATCH_TOTAL", "UNDER", 50), leg("MATCH_TOTAL", "OVER", 50, "SECOND_HALF")], "COVERED"),
    "corners": ([leg("CORNERS", "OVER", 950), leg("CORNERS", "UNDER", 950)], "COVERED"),
    "corners and cards": ([leg("CORNERS", "OVER", 950), leg("CARDS", "UNDER", 350)], "BOTH_LOSS_STATE"),
    "all parts": ([OVER, UNDER, leg("CORNERS", "OVER", 950), leg("CARDS", "UNDER", 400)], "COVERED"),
    "whole cards": ([leg("CARDS", "OVER", 400), leg("CARDS", "UNDER", 400)], "NON_EXHAUSTIVE"),
    "exact": ([leg("EXACT_SCORE", "2-1"), leg("MATCH_TOTAL", "OVER", 350)], "BOTH_LOSS_STATE"),
    "extra time": ([OVER, leg("MATCH_TOTAL", "UNDER", 250, "EXTRA_TIME")], "UNKNOWN_SETTLEMENT"),
    "no rule": ([OVER, leg("OUTRIGHT", "HOME")], "UNKNOWN_SETTLEMENT"),
    "no line": ([OVER, leg("MATCH_TOTAL", "UNDER")], "UNKNOWN_SETTLEMENT"),
    "twice": ([OVER, OVER], "INVALID_MARKET"),
    "empty": ([], "INVALID_MARKET"),
    "single": ([OVER], "NON_EXHAUSTIVE"),
}


def result(x, home, away, first):
    """A leg's result in plain Python; counts of its own part are passed as home, away."""
    family, period, participant, line, outcome = x
    if family not in ("CORNERS", "CARDS") and period != "FULL_MATCH":
        home, away = first if period == "FIRST_HALF" else (home - first[0], away - first[1])
    sign = lambda v: (v > 0) - (v < 0)
    if family in ("MATCH_TOTAL", "ASIAN_TOTAL", "CORNERS", "CARDS", "TEAM_TOTAL", "ASIAN_HANDICAP"):
        value = {"HOME": home, "AWAY": away}.get(participant, home + away)
        if family == "ASIAN_HANDICAP":
            value, line, outcome = (home - away) * (1 if participant == "HOME" else -1), -line, "OVER"
        lines = (line - 25, line + 25) if line % 50 == 25 else (line, line)
        return sum(sign(value * 100 - y) for y in lines) * (1 if outcome == "OVER" else -1)
    won = {"HOME": home > away, "DRAW": home == away, "AWAY": home < away, "HOME_OR_DRAW": home >= away, "HOME_OR_AWAY": home != away}.get(outcome, outcome == f"{home}-{away}")
    return 2 if won else -2


def vectors(legs, top=14):
    """The distinct vectors of a set over all counts, halves and parts, with no reduction by part."""
    of = lambda *names: [i for i, x in enumerate(legs) if (x[0] if x[0] in ("CORNERS", "CARDS") else "GOALS") in names]
    halves = any(legs[i][1] != "FULL_MATCH" for i in of("GOALS"))
    found = []
    for kind in ("GOALS", "CORNERS", "CARDS"):
        mine, seen = of(kind), set()
        for home, away in itertools.product(range(top), repeat=2):
            firsts = itertools.product(range(home + 1), range(away + 1)) if halves and kind == "GOALS" else [None]
            seen |= {tuple((i, result(legs[i], home, away, f)) for i in mine) for f in firsts}
        found.append(seen)
    return {tuple(r for _, r in sorted(sum(combo, ()))) for combo in itertools.product(*found)}


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], f"set string, legs array<{LEG}>")
    return {r["set"]: r for r in joint.judged(rows).collect()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_verdicts(judged, case):
    assert judged[case]["verdict"].split("+")[0] == CASES[case][1]
    assert (judged[case]["evidence"] is None) == (CASES[case][1] in ("COVERED", "UNKNOWN_SETTLEMENT", "INVALID_MARKET"))


@pytest.mark.parametrize("case", [k for k, v in sorted(CASES.items()) if v[1] not in ("UNKNOWN_SETTLEMENT", "INVALID_MARKET")])
def test_states_equal_the_whole_grid(judged, case):
    found = [tuple(x["vector"]) for x in judged[case]["states"]]
    assert len(found) == len(set(found)) == judged[case]["n_states"] and set(found) == vectors(CASES[case][0])


def test_states_settle_at_their_own_counts(judged):
    for case, (legs, _) in CASES.items():
        for x in judged[case]["states"] or []:
            first = (x["goals"]["first_home"], x["goals"]["first_away"])
            for y, r in zip(legs, x["vector"], strict=True):
                at = x["corners"] if y[0] == "CORNERS" else x["cards"] if y[0] == "CARDS" else x["goals"]
                assert result(y, at["home"], at["away"], first) == r


def test_evidence_and_counts(judged):
    assert judged["halves don't cover"]["evidence"] == "0-2/0-0|-|-"
    assert judged["corners and cards"]["evidence"] == "-|0-0|0-4"
    assert judged["all parts"]["n_cross"] > 0 and judged["all parts"]["n_overlap"] == 0


def test_nulls_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, [leg("MATCH_TOTAL", None, 250), OVER]), (None, [leg("MATCH_TOTAL", "UNDER", 150), OVER])], f"set int, legs array<{LEG}>")
    assert {(r["set"], r["verdict"]) for r in joint.judged(rows).collect()} == {(1, "INVALID_MARKET"), (2, "UNKNOWN_SETTLEMENT"), (None, "BOTH_LOSS_STATE")}
    assert joint.judged(rows.limit(0)).count() == 0


def test_simplex_equals_vertices():
    rng = np.random.default_rng(3)
    for states, legs in ((4, 2), (6, 3), (7, 4), (1, 1), (5, 5)):
        stack = rng.choice([0.0, 0.5, 1.0, 1.4, 1.9, 2.6], size=(60, states, legs))
        values, shares = joint.simplex_stack(stack)
        assert np.allclose(values, coverage.maximin_stack(stack)[0], atol=1e-8)
        assert np.allclose(shares.sum(axis=1), 1) and (shares >= 0).all()


def test_simplex_of_many_legs_has_a_certificate():
    """No share beats the value: weights on states under which no leg pays more, found by the same solve of the other side."""
    stack = np.random.default_rng(4).uniform(0, 3, size=(20, 60, 12))
    values, _ = joint.simplex_stack(stack)
    other, _ = joint.simplex_stack((4 - stack).transpose(0, 2, 1))
    assert np.allclose(values, 4 - other, atol=1e-8)


def test_stakes(spark):
    vectors_ = [[2, -2, 2], [-2, 2, -2]]
    rows = spark.createDataFrame(
        [(1, vectors_, [2.1, 2.0, 5.0]), (2, vectors_, [2.0, None, 3.0]), (3, [], [2.0]), (4, vectors_, [1.5, 1.5, 1.2]), (5, None, None), (6, [[2, None]], [2.0, 3.0])],
        "id int, vectors array<array<int>>, odds array<double>",
    )
    found = {r["id"]: r for r in joint.staked(rows).collect()}
    assert abs(found[1]["min_return"] - 100 / (1 / 5 + 1 / 2)) < 1e-9 and abs(sum(found[1]["stakes"]) - 100) < 1e-9 and found[1]["is_arb"]
    assert not found[4]["is_arb"] and found[4]["profit"] < 0
    assert all(found[i]["stakes"] is None and not found[i]["is_arb"] and found[i]["min_return"] is None for i in (2, 3, 5, 6))


PRICED = {"complement": ([2.1, 2.0], True), "result": ([3.2, 3.3, 2.9], True), "double chance and result": ([1.95, 2.1], True), "three legs of two markets": ([3.6, 4.4, 2.2], True)}


def test_prices_of_covered_cases(spark, judged):
    rows = [(k, [x["vector"] for x in judged[k]["states"]], odds, arb) for k, (odds, arb) in PRICED.items()]
    rows.append(("overround", rows[1][1], [1.95, 3.0, 4.0], False))
    found = joint.staked(spark.createDataFrame(rows, "name string, vectors array<array<int>>, odds array<double>, want boolean")).collect()
    assert len(found) == 5 and all(r["is_arb"] == r["want"] for r in found)
