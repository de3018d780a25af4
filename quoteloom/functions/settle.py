"""Settlement as column expressions.

A result is an integer: 2 full win, 1 half win, 0 push, -1 half loss, -2 full loss. Lines are integer cents, so a
quarter line (25 or 75 cents) is the sum of its two neighbours' signs and no float is compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import market

#: Results by their integer.
NAMES = {2: "FULL_WIN", 1: "HALF_WIN", 0: "PUSH", -1: "HALF_LOSS", -2: "FULL_LOSS"}


def is_quarter(line_c: Column) -> Column:
    return F.pmod(line_c, F.lit(100)).isin(25, 75)


def line_result(value_c: Column, line_c: Column) -> Column:
    """Result of the side that wins above a line, for a value in cents."""
    sign = lambda x: F.signum(x).cast("int")
    return F.when(is_quarter(line_c), sign(value_c - line_c + 25) + sign(value_c - line_c - 25)).otherwise(2 * sign(value_c - line_c))


def won(condition: Column) -> Column:
    """A full win or loss; null where the condition is, as without a score."""
    return F.when(condition, 2).when(~condition, -2)


def total_result(outcome: Column, total: Column, line_c: Column) -> Column:
    over = line_result(total * 100, line_c)
    return F.when(outcome == "OVER", over).when(outcome == "UNDER", -over)


def handicap_result(participant: Column, margin: Column, line_c: Column) -> Column:
    """margin: home minus away; the line is added to the participant's side."""
    own = F.when(participant == "HOME", margin).otherwise(-margin)
    return line_result(own * 100, -line_c)


def result_1x2(outcome: Column, margin: Column) -> Column:
    """Result market and double chance; null for any other outcome."""
    return (
        F.when(outcome == "HOME", won(margin > 0)).when(outcome == "DRAW", won(margin == 0)).when(outcome == "AWAY", won(margin < 0))
        .when(outcome == "HOME_OR_DRAW", won(margin >= 0)).when(outcome == "HOME_OR_AWAY", won(margin != 0)).when(outcome.isin("AWAY_OR_DRAW", "DRAW_OR_AWAY"), won(margin <= 0))
    )


def btts_result(outcome: Column, home: Column, away: Column) -> Column:
    both = (home >= 1) & (away >= 1)
    return F.when(outcome == "BTTS_YES", won(both)).when(outcome == "BTTS_NO", won(~both))


def exact_result(outcome: Column, home: Column, away: Column) -> Column:
    """Outcome ``H-A``; null if it is not a score."""
    part = lambda i: F.try_element_at(F.split(outcome, "-"), F.lit(i)).try_cast("int")
    return F.when(outcome.rlike("^[0-9]+-[0-9]+$"), won((part(1) == home) & (part(2) == away)))


#: Families that are settled as a total of both sides, whatever is counted.
TOTALS = ["MATCH_TOTAL", "ASIAN_TOTAL", "CORNERS", "CARDS"]


def settle(family: Column, outcome: Column, participant: Column, line_c: Column, home: Column, away: Column) -> Column:
    """The result of a selection for a final score, or count of corners or cards; null if it can't be settled."""
    own = F.when(participant == "HOME", home).when(participant == "AWAY", away)
    side = F.when(outcome.isin("HOME", "AWAY"), F.coalesce(participant, outcome))
    return (
        F.when(family.isin(TOTALS), total_result(outcome, home + away, line_c))
        .when(family.isin("TEAM_TOTAL", "TEAM_ASIAN_TOTAL"), total_result(outcome, own, line_c))
        .when((family == "ASIAN_HANDICAP") & side.isNotNull(), handicap_result(side, home - away, line_c))
        .when(family.isin("MATCH_RESULT", "DOUBLE_CHANCE"), result_1x2(outcome, home - away))
        .when(family == "BTTS", btts_result(outcome, home, away))
        .when(family == "EXACT_SCORE", exact_result(outcome, home, away))
    )


def settle_periods(rows: DataFrame) -> DataFrame:
    """Adds result, the name of a selection's result in its own period, and reason, why there is none.

    rows: family, period, outcome, participant, line_c, status and the scores first, full, second, extra, penalties, corners,
    cards, each a struct (home, away) or null; corners and cards are counted over the match, whatever the period. The score
    is a column of its own before it is settled, so the many rules that read it don't each work it out.
    """
    family, outcome, participant, line_c, status = (F.col(c) for c in ("family", "outcome", "participant", "line_c", "status"))
    goals = market.period_score(F.col("period"), *(F.col(c) for c in ("first", "full", "second", "extra", "penalties")))
    score = F.when(family == "CORNERS", F.col("corners")).when(family == "CARDS", F.col("cards")).otherwise(goals)
    scored = rows.withColumn("_score", score).withColumn("_home", F.col("_score.home")).withColumn("_away", F.col("_score.away"))
    points = scored.withColumn("_points", settle(family, outcome, participant, line_c, F.col("_home"), F.col("_away")))
    settled = points.withColumn("result", settle_match(status, F.col("_points")))
    teams = family.isin("TEAM_TOTAL", "TEAM_ASIAN_TOTAL")
    lined = family.isin(TOTALS) | teams | ((family == "ASIAN_HANDICAP") & outcome.isin("HOME", "AWAY"))
    reason = (
        F.when(F.col("result").isNotNull(), F.lit(None).cast("string")).when(~status.eqNullSafe("FINISHED"), "not finished").when(~family.isin([s[0] for s in market.SPECS]), "no rule")
        .when(F.col("_home").isNull(), "no score").when(teams & participant.isNull(), "no participant").when(lined & line_c.isNull(), "no line").otherwise("outcome")
    )
    return settled.withColumn("reason", reason).drop("_score", "_home", "_away", "_points")


def combined(components: Column) -> Column:
    """The result of a stake split over components WIN, LOSS, PUSH, VOID; null where they have none: of no components, of some void ones, of a win and a loss."""
    has = lambda x: F.array_contains(components, x)
    every = lambda x: F.forall(components, lambda c: c == x)
    return (
        F.when((F.size(components) == 0) | (has("WIN") & has("LOSS")), F.lit(None).cast("string")).when(has("VOID"), F.when(every("VOID"), "VOID"))
        .when(has("WIN"), F.when(every("WIN"), "FULL_WIN").otherwise("HALF_WIN")).when(has("LOSS"), F.when(every("LOSS"), "FULL_LOSS").otherwise("HALF_LOSS")).when(every("PUSH"), "PUSH")
    )


def settle_match(status: Column, result: Column) -> Column:
    """Name of a result given the match's status: void if it was called off, null if it is not finished."""
    names = F.create_map(*(x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))))
    return F.when(status.isin("CANCELLED", "ABANDONED", "POSTPONED"), "VOID").when(status == "FINISHED", names[result])


def multiplier(result: Column, odds: Column) -> Column:
    """What a stake of 1 returns."""
    return F.when(result == 2, odds).when(result == 1, (odds + 1) / 2).when(result == 0, 1.0).when(result == -1, 0.5).when(result == -2, 0.0)


#: The same by result + 2, for stacked solves: a return is a share of the odds and one of the stake.
SHARE_OF_ODDS, SHARE_OF_STAKE = np.array([0.0, 0.0, 0.0, 0.5, 1.0]), np.array([0.0, 0.5, 1.0, 0.5, 0.0])


def boundary(family: Column, line_c: Column) -> Column:
    """The largest goal count a selection speaks of."""
    binary = F.when(family.isin("BTTS", "MATCH_RESULT", "DOUBLE_CHANCE"), 1).otherwise(0)
    return F.greatest(binary, F.coalesce(F.ceil(F.abs(line_c) / 100), F.lit(0))).cast("int")


def goal_limit(boundary_max: Column, cap: int = 40) -> Column:
    """Goals a side has in the states to look at: 0 to this."""
    return F.least(F.greatest(boundary_max + 1, F.lit(2)), F.lit(cap))
