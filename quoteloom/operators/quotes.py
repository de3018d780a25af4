"""Best prices, candidate legs, pruning and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pairs of families that may be combined, besides equal ones; each in the order of their names.
COMPATIBLE = [("MATCH_TOTAL", "TEAM_TOTAL"), ("ASIAN_TOTAL", "MATCH_TOTAL"), ("ASIAN_TOTAL", "TEAM_TOTAL"), ("DOUBLE_CHANCE", "MATCH_RESULT"), ("BTTS", "MATCH_TOTAL")]
OPPOSITE = [("OVER", "UNDER"), ("BTTS_YES", "BTTS_NO"), ("HOME", "AWAY")]
LEG = ["event", "slot", "book", "family", "market_type", "participant", "line_c", "outcome", "odds", "observed_ms", "leg_id"]


def best_price(quotes: DataFrame, keys=("event", "slot")) -> DataFrame:
    """The best quote of each selection; of equal odds that of the smallest leg id. Partial aggregation, no sort."""
    rest = [c for c in quotes.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct("odds", F.negative(F.col("book")))).alias("top")
    return quotes.groupBy(*keys).agg(top).select(*keys, "top.*")


def diversified(quotes: DataFrame) -> DataFrame:
    """Best quotes per event, books spread: in slot order, a best quote whose book is taken gives way to one of equal odds from a free book.

    An ordered fold over the slots of an event (a few), in one aggregate expression.
    """
    top = quotes.withColumn("best", F.max("odds").over(Window.partitionBy("event", "slot"))).where(F.col("odds") == F.col("best"))
    slots = top.groupBy("event", "slot").agg(F.max("odds").alias("odds"), F.array_sort(F.collect_set("book")).alias("books"))
    order = slots.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("slot", "odds", "books"))).alias("list"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<slot:int,odds:double,book:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["books"], lambda b: ~F.array_contains(acc["used"], b))
        book = F.coalesce(F.get(free, F.lit(0)), x["books"][0])
        return F.struct(F.array_union(acc["used"], F.array(book)).alias("used"), F.concat(acc["out"], F.array(F.struct(x["slot"].alias("slot"), x["odds"].alias("odds"), book.alias("book")))).alias("out"))

    return order.select("event", F.explode(F.aggregate("list", start, step)["out"]).alias("o")).select("event", "o.*")


def compatible(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    out = a == b
    for x, y in COMPATIBLE:
        out = out | ((low == x) & (high == y))
    return out


def _beyond(slot: Column):
    return lambda x: x["slot"] > slot


def _combined(best: DataFrame, names: str) -> DataFrame:
    """Sets of pairwise compatible selections of an event in slot order, one after another in ``names``.

    An event has at most one best quote a slot, so its selections are gathered once and combined in place: no self-join.
    """
    fields = [c for c in LEG if c != "event"]
    rows = best.groupBy("event").agg(F.collect_list(F.struct(*fields)).alias("legs"))
    for i, name in enumerate(names):
        last = F.col(f"{names[i - 1]}.slot")
        later = F.filter("legs", _beyond(last)) if i else F.col("legs")
        rows = rows.select("event", "legs", *names[:i], F.explode(later).alias(name))
        for other in names[:i]:
            rows = rows.where(compatible(F.col(f"{other}.family"), F.col(f"{name}.family")))
    return rows.select("event", *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in names for c in fields))


def pairs(best: DataFrame) -> DataFrame:
    """All compatible pairs of an event's selections, a before b by slot."""
    return _combined(best, "ab")


def triples(best: DataFrame) -> DataFrame:
    """All pairwise compatible triples of an event's selections, in slot order."""
    return _combined(best, "abc")


def held(prices: DataFrame) -> DataFrame:
    """slots (a bit each, of slots below 63), events: the sets of selections that events have prices of, and how many events have each.

    One bit a selection, set before the shuffle, so an event's rows are combined in place and none is sorted or carries a name.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))
    sets = prices.where("event is not null").groupBy("event").agg(F.bit_or(bit).alias("slots"))
    return sets.groupBy("slots").agg(F.count("*").alias("events"))


def structures_of(slots: DataFrame, names: str) -> DataFrame:
    """bits, legs, structure of the compatible pairs or triples of selections: a dimension of a few hundred rows."""
    fields = {"event": "long", "book": "long", "odds": "double", "observed_ms": "long", "leg_id": "string"}
    one = slots.select("*", *((F.lit(0) if c == "event" else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()))
    bits = sum((F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"slot_{x}")) for x in names), F.lit(0).cast("long"))
    return _combined(one, names).select(bits.alias("bits"), F.lit(len(names)).alias("legs"), structure(len(names)).alias("structure"))


def capped(candidates: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` candidates in a stated order, with their number: the cap is the feature, so it is global."""
    kept = candidates.orderBy(*order).limit(cap)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def opposite(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in OPPOSITE:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out


def is_complement() -> Column:
    """Whether a and b are the two sides of one market line."""
    c = F.col
    return (c("family_a") == c("family_b")) & c("participant_a").eqNullSafe(c("participant_b")) & c("line_c_a").eqNullSafe(c("line_c_b")) & opposite(c("outcome_a"), c("outcome_b"))


def structure(legs: int) -> Column:
    """The kind of a candidate of two or three legs."""
    families = F.array_distinct(F.array(*(F.col(f"family_{x}") for x in "abc"[:legs])))
    first = F.col("family_a")
    many = "MULTI_LEG_PARTITION" if legs >= 3 else "GENERIC"
    both = F.array_contains(families, "TEAM_TOTAL") & F.array_contains(families, "MATCH_TOTAL")
    return (
        F.when((F.size(families) > 1) & both, "TEAM_TOTAL_MATCH_TOTAL").when(F.size(families) > 1, many)
        .when(first == "MATCH_TOTAL", F.when(is_complement(), "SAME_MARKET_COMPLEMENT").otherwise("COMPLEMENTARY_TOTALS") if legs == 2 else F.lit("COMPLEMENTARY_TOTALS"))
        .when(first == "ASIAN_TOTAL", "ASIAN_LINE").when(first == "ASIAN_HANDICAP", "PROTECTED_HANDICAP").when(first.isin("MATCH_RESULT", "DOUBLE_CHANCE"), "PARTITION").otherwise(many)
    )


def prune_reasons(now_ms: Column, max_age_ms: int, min_odds: float = 1.0000001) -> Column:
    """All reasons against a pair, sorted."""
    reasons = {
        "INVALID_ODDS": (F.col("odds_a") <= min_odds) | (F.col("odds_b") <= min_odds),
        "STALE_ODDS": (now_ms - F.col("observed_ms_a") > max_age_ms) | (now_ms - F.col("observed_ms_b") > max_age_ms),
        "DUPLICATE_SELECTION": (F.col("slot_a") == F.col("slot_b")),
        "SAME_BOOKMAKER": F.col("book_a") == F.col("book_b"),
        "INCOMPATIBLE_MARKET": ~compatible(F.col("family_a"), F.col("family_b")),
        "PRICE_PREFILTER": is_complement() & (1 / F.col("odds_a") + 1 / F.col("odds_b") >= 1),
    }
    found = F.array(*(F.when(bad, name) for name, bad in sorted(reasons.items())))
    return F.array_compact(found)
