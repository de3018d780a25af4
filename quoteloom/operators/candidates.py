"""All the reasons against a candidate of any number of legs, as expressions over its array of legs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import quotes

#: Why a candidate is pruned, and the rejection that is reported for it.
REJECTIONS = {
    "CANDIDATE_SIZE": "INVALID_MARKET",
    "EVENT_MISMATCH": "EVENT_MISMATCH",
    "PERIOD_MISMATCH": "PERIOD_MISMATCH",
    "DUPLICATE_SELECTION": "INVALID_MARKET",
    "INVALID_ODDS": "INVALID_ODDS",
    "SUSPENDED": "INVALID_MARKET",
    "STALE_ODDS": "STALE_ODDS",
    "SAME_BOOKMAKER": "STAKE_LIMIT",
    "EVENT_UNCERTAIN": "EVENT_MATCH_UNCERTAIN",
    "INCOMPATIBLE_MARKET": "UNSUPPORTED_MARKET",
    "PRICE_PREFILTER": "NEGATIVE_GUARANTEED_PROFIT",
}


def selection_key(leg: Column) -> Column:
    return F.concat_ws("|", leg["family"], leg["period"], F.coalesce(leg["participant"], F.lit("-")), F.coalesce(leg["line_c"].cast("string"), F.lit("-")), leg["outcome"])


def complement(a: Column, b: Column) -> Column:
    """Whether two legs are the two sides of one market line."""
    same = a["participant"].eqNullSafe(b["participant"]) & a["line_c"].eqNullSafe(b["line_c"])
    return (a["family"] == b["family"]) & (a["period"] == b["period"]) & same & quotes.opposite(a["outcome"], b["outcome"])


def prune(legs: Column, event: Column, period: Column, now_ms: int, max_age_ms: int | None = None, least_confidence: float = 0.8, least_odds: float = 1.0, same_book: bool = False) -> Column:
    """The sorted reasons against a candidate; an empty array for one to go on with.

    legs: array of (event, period, family, participant, line_c, outcome, book, odds, suspended, confidence, observed_ms).
    A confidence or a time that isn't known is no reason.
    """
    some = lambda f: F.coalesce(F.exists(legs, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))
    fewer = lambda of: F.size(F.array_distinct(F.transform(legs, of))) < F.size(legs)
    families = F.array_distinct(F.transform(legs, lambda x: x["family"]))
    a, b = F.get(legs, F.lit(0)), F.get(legs, F.lit(1))
    total = 1 / a["odds"] + 1 / b["odds"]
    reasons = {
        "CANDIDATE_SIZE": F.size(legs) < 2,
        "EVENT_MISMATCH": some(lambda x: x["event"] != event),
        "PERIOD_MISMATCH": some(lambda x: x["period"] != period),
        "DUPLICATE_SELECTION": fewer(selection_key),
        "INVALID_ODDS": some(lambda x: x["odds"].isNull() | F.isnan(x["odds"]) | (x["odds"] <= least_odds) | (x["odds"] == float("inf"))),
        "SUSPENDED": some(lambda x: x["suspended"]),
        "STALE_ODDS": some(lambda x: now_ms - x["observed_ms"] > max_age_ms) if max_age_ms is not None else F.lit(False),
        "SAME_BOOKMAKER": F.lit(False) if same_book else (F.size(legs) >= 2) & fewer(lambda x: x["book"]),
        "EVENT_UNCERTAIN": some(lambda x: x["confidence"] < least_confidence),
        "INCOMPATIBLE_MARKET": F.exists(families, lambda x: F.exists(families, lambda y: ~quotes.compatible(x, y))),
        "PRICE_PREFILTER": F.coalesce((F.size(legs) == 2) & complement(a, b) & (total >= 1) & ~F.isnan(total), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in sorted(reasons.items()))))


def prune_compatible(legs: list[Column], repeated: Column, sides: Column, least_confidence: float = 0.8, least_odds: float = 1.0) -> Column:
    """As ``prune`` for compatible selections of one event and period, in any order of time.

    legs: columns, null where a candidate has fewer. What depends on selections only is known: whether one is ``repeated``, and
    whether they are the two ``sides`` of a line. Written out a leg, so it is compiled, which functions over arrays aren't.
    """
    some = lambda f: reduce(or_, (F.coalesce(x.isNotNull() & f(x), F.lit(False)) for x in legs))
    total = 1 / legs[0]["odds"] + 1 / legs[1]["odds"]
    reasons = {
        "DUPLICATE_SELECTION": repeated,
        "INVALID_ODDS": some(lambda x: x["odds"].isNull() | F.isnan(x["odds"]) | (x["odds"] <= least_odds) | (x["odds"] == float("inf"))),
        "SUSPENDED": some(lambda x: x["suspended"]),
        "SAME_BOOKMAKER": reduce(or_, (x.isNotNull() & y.isNotNull() & x["book"].eqNullSafe(y["book"]) for x, y in combinations(legs, 2))),
        "EVENT_UNCERTAIN": some(lambda x: x["confidence"] < least_confidence),
        "PRICE_PREFILTER": F.coalesce(sides & (total >= 1) & ~F.isnan(total), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in sorted(reasons.items()))))


def rejections(reasons: Column) -> Column:
    """The sorted distinct rejections reported for reasons."""
    named = F.create_map(*(F.lit(x) for kv in REJECTIONS.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(reasons, lambda r: F.element_at(named, r))))


def leg_key(ids: Column) -> Column:
    """Sorted distinct leg ids."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), ",")


def episode_key(event: Column, structure: Column, ids: Column) -> Column:
    """The key under which detections of the same opportunity are one episode."""
    return F.concat(F.lit("episode:"), event.cast("string"), F.lit(":"), structure, F.lit(":"), F.array_join(F.array_sort(F.array_distinct(ids)), "+"))


def duplicates(ids: Column) -> Column:
    """The sorted ids that occur more than once."""
    ordered = F.array_sort(ids)
    return F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (F.get(ordered, i - 1) == x)))
