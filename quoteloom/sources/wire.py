"""Nested provider payloads to flat prices: schema, flattening, validation, merge into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME = "struct<name:string,price:double,point:double>"
MARKET = f"struct<key:string,last_update:string,outcomes:array<{OUTCOME}>>"
BOOK = f"struct<key:string,title:string,last_update:string,markets:array<{MARKET}>>"
PAYLOAD = f"array<struct<id:string,sport_key:string,commence_time:string,home_team:string,away_team:string,status:string,bookmakers:array<{BOOK}>>>"

#: Provider key, family, whether a line is needed. Keys without a proven settlement (``spreads``) are left out.
KEYS = [("h2h", "MATCH_RESULT", False), ("totals", "MATCH_TOTAL", True), ("btts", "BTTS", False), ("double_chance", "DOUBLE_CHANCE", False)]


def flatten(payloads: DataFrame) -> DataFrame:
    """One row per outcome of payloads (body: JSON): event, book, key, name, price, line, source time, skip (why it is left out, or null).

    A market's time is its own or else its book's. The line is the outcome's point or else the last number of its name.
    """
    e = payloads.select(F.explode(F.from_json("body", PAYLOAD)).alias("e"))
    b = e.select("e.id", "e.home_team", "e.away_team", "e.commence_time", F.explode("e.bookmakers").alias("b"))
    m = b.select("*", F.explode("b.markets").alias("m"))
    o = m.select("*", F.explode("m.outcomes").alias("o"))
    keys = payloads.sparkSession.createDataFrame(KEYS, "key string, family string, lined boolean")
    found = F.regexp_extract_all("o.name", F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    line = F.coalesce(F.col("o.point").cast("string"), F.regexp_replace(F.try_element_at(found, F.lit(-1)), ",", "."))
    rows = o.select(
        F.col("id").alias("event_id"), "home_team", "away_team", F.try_to_timestamp("commence_time").alias("starts_at"), F.col("b.key").alias("book"), F.col("m.key").alias("key"),
        F.col("o.name").alias("name"), F.col("o.price").alias("price"), line.alias("line"), F.try_to_timestamp(F.coalesce("m.last_update", "b.last_update")).alias("source_at"),
    ).join(F.broadcast(keys), "key", "left")
    skip = (
        F.when(F.col("family").isNull(), "unknown_market").when(F.col("source_at").isNull(), "missing_timestamp").when(F.coalesce(F.col("price") <= 1, F.lit(True)), "bad_price")
        .when(F.col("lined") & F.col("line").isNull(), "missing_line").when(F.col("home_team") == F.col("away_team"), "same_team")
    )
    return rows.withColumn("skip", skip)


def canonical(rows: DataFrame, received_at: str) -> DataFrame:
    """Valid rows with ids, their source time never after the time of receipt."""
    at = F.least("source_at", F.to_timestamp(F.lit(received_at)))
    return rows.where("skip is null").select(F.concat_ws(":", "event_id", "key", "book", "name", "line").alias("selection_id"), "event_id", "family", "book", "name", "line", "price", at.alias("source_at"))


def merge(stored: DataFrame, incoming: DataFrame, key: str, changed: str) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rows whose ``changed`` column is new or other): an upsert as a full join of two snapshots."""
    a, b = stored.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    snapshot = both.select(*(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in stored.columns))
    moved = both.where(F.col(f"b.{key}").isNotNull() & ~F.col(f"a.{changed}").eqNullSafe(F.col(f"b.{changed}"))).select("b.*")
    return snapshot, moved
