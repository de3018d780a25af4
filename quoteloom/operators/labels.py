"""Market identity from what providers call a market: registered keys first, else the words of its label.

A label that no rule fits is refused with a reason, never guessed. Labels repeat: each distinct one is folded and
classified once, and the rows get its columns back by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import market
from . import resolve

#: What labels say, as (parts, whole words); one of either is enough.
TERMS = {
    "double chance": (["double chance", "doublechance"], []),
    "exact score": (["correct score", "exact score", "score cast"], []),
    "both score": (["both teams to score", "both to score", "btts"], []),
    "draw no bet": (["draw no bet", "dnb"], []),
    "player": (["goalscorer", "player props"], []),
    "corners": ([], ["corners"]),
    "cards": (["yellow card", "red card"], ["cards"]),
    "shots": ([], ["shots"]),
    "asian": ([], ["asian"]),
    "team": ([], ["team"]),
    "handicap": ([], ["handicap"]),
    "any handicap": (["hcap"], ["handicap"]),
    "total": (["total", "over", "under", "o u", "goals"], []),
    "result": (["match result", "h2h", "three way"], []),
    "home": ([], ["home", "hosts"]),
    "away": ([], ["away", "visitors"]),
}
#: Terms that a label must all have, and its family; the first row that fits counts.
FAMILY_RULES = [
    (["double chance"], "DOUBLE_CHANCE"),
    (["exact score"], "EXACT_SCORE"),
    (["both score"], "BTTS"),
    (["draw no bet"], None),
    (["player"], None),
    (["corners"], "CORNERS"),
    (["cards"], "CARDS"),
    (["shots"], None),
    (["asian", "handicap"], "ASIAN_HANDICAP"),
    (["asian", "team"], "TEAM_ASIAN_TOTAL"),
    (["asian", "total"], "ASIAN_TOTAL"),
    (["team", "total"], "TEAM_TOTAL"),
    (["any handicap"], "ASIAN_HANDICAP"),
    (["total"], "MATCH_TOTAL"),
    (["result"], "MATCH_RESULT"),
]
#: Why a label of a rule without a family is refused.
REFUSED = {"draw no bet": "draw no bet is intentionally unmapped", "player": "player markets have no family", "shots": "shots have no family"}
#: Words before "half".
HALVES = {"FIRST_HALF": ["1st", "first", "1"], "SECOND_HALF": ["2nd", "second", "2"]}
NUMBER = r"(-?[0-9]+(?:[.,][0-9]+)?)"
KEY_SCHEMA = "provider string, key string, family string, period string, participant string, line string"


def says(text: Column, term: str) -> Column:
    """Whether a folded label (single blanks) has a term."""
    parts, words = TERMS[term]
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    return reduce(lambda a, b: a | b, [*(text.contains(p) for p in parts), *(spaced.contains(f" {w} ") for w in words)])


def is_1x2(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("")) == "1x2"


def family_of(text: Column) -> Column:
    """(family, reason) of a folded label: one of the two is null."""
    answer = lambda family, reason: F.struct(F.lit(family).cast("string").alias("family"), F.lit(reason).cast("string").alias("reason"))
    fits = [(reduce(lambda a, b: a & b, [says(text, t) for t in terms]), answer(family, None if family else REFUSED[terms[0]])) for terms, family in FAMILY_RULES]
    rules = reduce(lambda c, rule: c.when(*rule), fits[1:], F.when(*fits[0]))
    return rules.when(is_1x2(text), answer("MATCH_RESULT", None)).otherwise(answer(None, "no rule fits the label"))


def period_of(text: Column) -> Column:
    """The period a folded label speaks of: by "extra time", or by the word before the first "half"."""
    words = F.split(text, " ")
    before = F.get(words, (F.array_position(words, "half") - 2).cast("int"))
    halves = F.when(before.isin(HALVES["FIRST_HALF"]), "FIRST_HALF").when(before.isin(HALVES["SECOND_HALF"]), "SECOND_HALF")
    return F.when(text.contains("extra time"), "EXTRA_TIME").otherwise(F.coalesce(halves, F.lit("FULL_MATCH")))


def participant_of(text: Column) -> Column:
    return F.when(~is_1x2(text), F.when(says(text, "home"), "HOME").when(says(text, "away"), "AWAY"))


def line_in(raw: Column) -> Column:
    """The last number of a raw text as a line; null without one."""
    return market.canonical_line(F.try_element_at(F.regexp_extract_all(raw, F.lit(NUMBER), F.lit(1)), F.lit(-1)))


def line_of_outcomes(outcomes: Column) -> Column:
    """The line most outcomes (name, point) state, the first one of several; null if none does."""
    stated = F.array_compact(F.transform(outcomes, lambda o: F.coalesce(market.canonical_line(o["point"]), line_in(o["name"]))))
    kinds = F.array_distinct(stated)
    counts = F.transform(kinds, lambda k: F.size(F.filter(stated, lambda s: s == k)))
    return F.get(kinds, (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))


def normalize_markets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds matched, reason, family, period, market_type, participant, line, via and problems to ``rows``.

    rows: provider, key, label, outcomes (array of name, point) and any others; keys: a registry of ``KEY_SCHEMA``, one row
    a provider and key, broadcast as it is a configured dimension. A null label is none. Problems name what a matched
    market needs and nothing states: its line or participant.
    """
    labels = rows.select("label").where("label is not null").distinct().withColumn("text", resolve.normalize_text("label"))
    text = F.col("text")
    labels = labels.select("label", family_of(text).alias("said"), period_of(text).alias("said_period"), participant_of(text).alias("said_participant"), line_in(F.col("label")).alias("said_line"))
    known = keys.select("provider", "key", F.struct("family", "period", "participant", "line").alias("known"))
    specs = rows.sparkSession.createDataFrame([(f, t, p, n) for f, t, p, n, _ in market.SPECS], "family string, market_type string, takes_participant boolean, takes_line boolean")
    joined = rows.join(F.broadcast(known), ["provider", "key"], "left").join(labels, "label", "left")
    hit = F.col("known").isNotNull()
    joined = joined.withColumn("family", F.when(hit, F.col("known.family")).otherwise(F.col("said.family"))).join(F.broadcast(specs), "family", "left")  # 11 families
    matched, takes_line, takes_participant = F.col("family").isNotNull(), F.col("takes_line"), F.col("takes_participant")
    line = F.when(takes_line, F.coalesce("said_line", line_of_outcomes(F.col("outcomes"))))
    participant = F.coalesce("known.participant", F.when(takes_participant, F.col("said_participant")))
    problems = F.array_compact(F.array(F.when(takes_line & line.isNull(), "line"), F.when(takes_participant & participant.isNull(), "participant")))
    return joined.select(
        *(F.col(c) for c in rows.columns),
        matched.alias("matched"),
        F.when(~matched, F.coalesce("said.reason", F.lit("unknown key and no label"))).alias("reason"),
        "family",
        F.when(matched, F.when(hit, F.col("known.period")).otherwise(F.col("said_period"))).alias("period"),
        "market_type",
        F.when(matched, participant).alias("participant"),
        F.when(matched, F.coalesce(line, F.col("known.line"))).alias("line"),
        F.when(matched, F.when(hit, "key").otherwise("label")).alias("via"),
        F.when(matched, problems).alias("problems"),
    )
