"""Market structures, outcome labels, statuses and headers as providers send them, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Family, market type, whether a participant and a line are needed (they are forbidden otherwise), outcomes.
SPECS = [
    ("MATCH_RESULT", "1X2", False, False, ["HOME", "DRAW", "AWAY"]),
    ("DOUBLE_CHANCE", "DOUBLE_CHANCE", False, False, ["HOME_OR_DRAW", "AWAY_OR_DRAW", "HOME_OR_AWAY"]),
    ("MATCH_TOTAL", "STANDARD", False, True, ["OVER", "UNDER"]),
    ("ASIAN_TOTAL", "ASIAN", False, True, ["OVER", "UNDER"]),
    ("ASIAN_HANDICAP", "HANDICAP", True, True, ["HOME", "AWAY"]),
    ("TEAM_TOTAL", "STANDARD", True, True, ["OVER", "UNDER"]),
    ("TEAM_ASIAN_TOTAL", "ASIAN", True, True, ["OVER", "UNDER"]),
    ("CORNERS", "STANDARD", False, True, ["OVER", "UNDER"]),
    ("CARDS", "STANDARD", False, True, ["OVER", "UNDER"]),
    ("BTTS", "BTTS", False, False, ["BTTS_YES", "BTTS_NO"]),
    ("EXACT_SCORE", "EXACT_SCORE", False, False, []),
]
#: What the store can hold as an outcome; exact scores are none of them.
OUTCOMES = ["HOME", "DRAW", "AWAY", "HOME_OR_DRAW", "AWAY_OR_DRAW", "HOME_OR_AWAY", "OVER", "UNDER", "BTTS_YES", "BTTS_NO"]
#: A provider's word for a match's status; any other is SCHEDULED.
STATUSES = {"live": "LIVE", "completed": "FINISHED", "postponed": "POSTPONED", "cancelled": "CANCELLED", "abandoned": "ABANDONED"}
#: Words of one provider alone.
OWN_STATUSES = {"parlay-api": {"final": "FINISHED"}}
#: Worker health to alert level.
LEVELS = {"ok": "HEALTHY", "starting": "HEALTHY", "degraded": "DEGRADED", "down": "DOWN", "error": "DOWN", "stale": "DOWN"}


def structure_problems(rows: DataFrame) -> DataFrame:
    """Adds ``problems``: what is wrong with each row's family, market_type, participant, line and outcome; empty if nothing is."""
    spec = rows.sparkSession.createDataFrame(SPECS, "family string, _type string, _participant boolean, _line boolean, _outcomes array<string>")
    joined = rows.join(F.broadcast(spec), "family", "left")  # 11 families
    score = F.col("outcome").rlike("^[0-9]+-[0-9]+$")
    named = F.when(F.col("family") == "EXACT_SCORE", score).otherwise(F.array_contains("_outcomes", F.col("outcome")))
    checks = {
        "unknown_family": F.col("_type").isNull(),
        "market_type": ~F.col("market_type").eqNullSafe(F.col("_type")),
        "participant_missing": F.col("_participant") & F.col("participant").isNull(),
        "participant_extra": ~F.col("_participant") & F.col("participant").isNotNull(),
        "line_missing": F.col("_line") & F.col("line").isNull(),
        "line_extra": ~F.col("_line") & F.col("line").isNotNull(),
        "outcome": ~F.coalesce(named, F.lit(False)),
    }
    known = F.col("_type").isNotNull()
    found = F.array_compact(F.array(*(F.when(bad if name == "unknown_family" else known & bad, name) for name, bad in checks.items())))
    return joined.select(*(F.col(c) for c in rows.columns), found.alias("problems"))


def structure_key(family: Column, period: Column, market_type: Column, participant: Column, line: Column) -> Column:
    """The identity of a market within its event."""
    return F.concat_ws("|", family, period, market_type, F.coalesce(participant, F.lit("_")), F.coalesce(line, F.lit("_")))


def label(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def map_outcome(family: Column, name: Column, home: Column, away: Column) -> Column:
    """A provider's label as an outcome of its family; null where it says none, as outcomes are never guessed."""
    t, side = label(name), F.when(label(name) == label(home), "HOME").when(label(name) == label(away), "AWAY")
    result = F.coalesce(side, F.when(t.isin("draw", "tie", "x"), "DRAW").when(t.isin("п1", "p1"), "HOME").when(t.isin("п2", "p2"), "AWAY"))
    total = F.when(t.startswith("over") | (t == "o"), "OVER").when(t.startswith("under") | (t == "u"), "UNDER")
    both = F.when(t.isin("yes", "y"), "BTTS_YES").when(t.isin("no", "n"), "BTTS_NO")
    double = (
        F.when(t.isin("1x", "x1", "home or draw", "home/draw"), "HOME_OR_DRAW").when(t.isin("x2", "2x", "draw or away", "draw/away"), "AWAY_OR_DRAW")
        .when(t.isin("12", "home or away", "home/away"), "HOME_OR_AWAY")
    )
    score = r"([0-9]{1,3})[^0-9]{0,2}([0-9]{1,3})"
    exact = F.when(t.rlike(score), F.concat_ws("-", F.regexp_extract(t, score, 1), F.regexp_extract(t, score, 2)))
    totals = [f for f, _, _, _, names in SPECS if names == ["OVER", "UNDER"]]
    return (
        F.when(family == "MATCH_RESULT", result).when(family.isin(*totals), total).when(family == "BTTS", both)
        .when(family == "DOUBLE_CHANCE", double).when(family == "EXACT_SCORE", exact).when(family == "ASIAN_HANDICAP", side)
    )


def representable(outcome: Column) -> Column:
    """The outcome, or null where the store has no value for it."""
    return F.when(outcome.isin(*OUTCOMES), outcome)


def map_status(provider: Column, word: Column) -> Column:
    """A provider's word for a match's status."""
    shared = reduce(lambda c, kv: c.when(word == kv[0], kv[1]), STATUSES.items(), F.when(F.lit(False), ""))
    for name, words in OWN_STATUSES.items():
        shared = reduce(lambda c, kv, name=name: c.when((provider == name) & (word == kv[0]), kv[1]), words.items(), shared)
    return shared.otherwise("SCHEDULED")


def quota(header: Column) -> Column:
    """A quota header as a whole number of at least 0; null for anything else."""
    value = F.when(F.trim(header) != "", F.trim(header).try_cast("double"))
    return F.when((value >= 0) & (value == F.floor(value)) & (value < 9.0e15), value.try_cast("long"))


def canonical_line(raw: Column) -> Column:
    """A line as a plain decimal: no plus sign, the first comma as a point; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), "^([^,]*),", "$1."), r"^\+", "")
    return F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t)


def alert_level(status: Column) -> Column:
    """The alert level of a worker's health; of a source's own status DEGRADED unless it is HEALTHY or DOWN."""
    worker = reduce(lambda c, kv: c.when(status == kv[0], kv[1]), LEVELS.items(), F.when(status.isin("HEALTHY", "DOWN"), status))
    return worker.otherwise("DEGRADED")


def period_score(period: Column, first: Column, full: Column, second: Column, extra: Column, penalties: Column) -> Column:
    """The score (home, away) of a period; a second half that isn't stated is full time less the first half."""
    rest = F.when(first.isNotNull() & full.isNotNull(), F.struct((full["home"] - first["home"]).alias("home"), (full["away"] - first["away"]).alias("away")))
    named = {"FULL_MATCH": full, "FIRST_HALF": first, "SECOND_HALF": F.coalesce(second, rest), "EXTRA_TIME": extra, "PENALTIES": penalties}
    return reduce(lambda c, kv: c.when(period == kv[0], kv[1]), named.items(), F.when(F.lit(False), full))


#: Keys of markets that hold a team's totals, and whose they are where a name says none.
TEAM_KEYS = {"team_totals_home": "HOME", "team_totals_away": "AWAY"}


def split_team_totals(outcomes: DataFrame) -> DataFrame:
    """Outcomes of team-total markets, dealt to one market a participant and line: adds participant, line, market_id, outcome and skip.

    outcomes: book, key, home_team, away_team, name, price, point (text) and any others, one row an outcome. Outcomes without a
    participant or line belong to no market and go; those with a bad price or a name of neither side stay with the tag
    ``book:key:name`` in skip and no outcome.
    """
    name, home, away = F.col("name"), F.col("home_team"), F.col("away_team")
    fallback = reduce(lambda c, kv: c.when(F.col("key") == kv[0], kv[1]), TEAM_KEYS.items(), F.when(F.lit(False), ""))
    participant = F.coalesce(F.when(label(name) == label(home), "HOME").when(label(name) == label(away), "AWAY"), fallback)
    last = F.regexp_replace(F.regexp_extract(F.trim(name), r"(?:^|\s)(-?[0-9]+(?:[.,][0-9]+)?)$", 1), ",", ".")
    line = F.coalesce(F.when(F.col("point").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("point")), F.when(last != "", last))
    rows = outcomes.where(F.col("key").isin(*TEAM_KEYS)).withColumn("participant", participant).withColumn("line", line).where("participant is not null and line is not null")
    outcome = F.when(F.col("price") > 1, map_outcome(F.lit("TEAM_TOTAL"), name, home, away))
    rows = rows.withColumn("market_id", F.concat_ws("::", "key", "participant", "line")).withColumn("outcome", outcome)
    return rows.withColumn("skip", F.when(F.col("outcome").isNull(), F.concat_ws(":", "book", "key", "name")))
