"""Domain tables from the driver's tables: priced legs, match scores, runs, price series and provider events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slot, family, market type, participant, line in cents, outcome, base price.
SLOTS = [
    (0, "MATCH_TOTAL", "OVER_UNDER", None, 250, "OVER", 1.60),
    (1, "MATCH_TOTAL", "OVER_UNDER", None, 250, "UNDER", 1.60),
    (2, "MATCH_TOTAL", "OVER_UNDER", None, 350, "UNDER", 1.35),
    (3, "ASIAN_TOTAL", "OVER_UNDER", None, 225, "OVER", 1.60),
    (4, "ASIAN_TOTAL", "OVER_UNDER", None, 225, "UNDER", 1.60),
    (5, "MATCH_RESULT", "1X2", None, None, "HOME", 2.2),
    (6, "MATCH_RESULT", "1X2", None, None, "DRAW", 2.6),
    (7, "MATCH_RESULT", "1X2", None, None, "AWAY", 2.4),
    (8, "DOUBLE_CHANCE", "DOUBLE_CHANCE", None, None, "HOME_OR_DRAW", 1.25),
    (9, "BTTS", "YES_NO", None, None, "BTTS_YES", 1.55),
    (10, "BTTS", "YES_NO", None, None, "BTTS_NO", 1.55),
    (11, "TEAM_TOTAL", "OVER_UNDER", "HOME", 150, "OVER", 1.70),
]
SLOT_SCHEMA = "slot int, family string, market_type string, participant string, line_c int, outcome string, base double"

#: Fixed values of selections over periods, corners and cards: slot, family, period, participant, line in cents, outcome, base price.
JOINT = [
    (0, "MATCH_RESULT", "FULL_MATCH", None, None, "HOME", 2.2),
    (1, "MATCH_RESULT", "FULL_MATCH", None, None, "DRAW", 2.6),
    (2, "MATCH_RESULT", "FULL_MATCH", None, None, "AWAY", 2.4),
    (3, "MATCH_TOTAL", "FULL_MATCH", None, 250, "OVER", 1.60),
    (4, "MATCH_TOTAL", "FULL_MATCH", None, 250, "UNDER", 1.60),
    (5, "MATCH_TOTAL", "FIRST_HALF", None, 150, "OVER", 1.60),
    (6, "MATCH_TOTAL", "FIRST_HALF", None, 150, "UNDER", 1.60),
    (7, "MATCH_RESULT", "FIRST_HALF", None, None, "HOME", 2.2),
    (8, "MATCH_RESULT", "FIRST_HALF", None, None, "DRAW", 2.0),
    (9, "MATCH_RESULT", "FIRST_HALF", None, None, "AWAY", 2.4),
    (10, "ASIAN_TOTAL", "SECOND_HALF", None, 125, "OVER", 1.60),
    (11, "ASIAN_TOTAL", "SECOND_HALF", None, 125, "UNDER", 1.60),
    (12, "CORNERS", "FULL_MATCH", None, 950, "OVER", 1.60),
    (13, "CORNERS", "FULL_MATCH", None, 950, "UNDER", 1.60),
    (14, "CORNERS", "FULL_MATCH", None, 1025, "OVER", 1.60),
    (15, "CARDS", "FULL_MATCH", None, 350, "OVER", 1.60),
    (16, "CARDS", "FULL_MATCH", None, 350, "UNDER", 1.60),
    (17, "CARDS", "FULL_MATCH", None, 400, "UNDER", 1.50),
    (18, "EXACT_SCORE", "FULL_MATCH", None, None, "2-1", 8.0),
    (19, "MATCH_TOTAL", "EXTRA_TIME", None, 50, "OVER", 1.60),
    (20, "BTTS", "SECOND_HALF", None, None, "BTTS_YES", 2.2),
    (21, "BTTS", "SECOND_HALF", None, None, "BTTS_NO", 1.3),
    (22, "TEAM_TOTAL", "FULL_MATCH", "HOME", 150, "OVER", 1.70),
    (23, "ASIAN_HANDICAP", "FIRST_HALF", "HOME", -50, "HOME", 1.90),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> DataFrame:
    """The market dimension: 12 rows."""
    return spark.createDataFrame(SLOTS, SLOT_SCHEMA)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per (event, slot, book): event, slot, book, odds, observed_ms, leg_id and the slot's columns."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("event"), (F.col("l_orderkey") % 12).cast("int").alias("slot"), F.col("l_suppkey").alias("book"), "l_discount", "l_tax", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms")
    )
    # narrow rows, all of an event together: what follows groups within an event, so nothing else is shuffled
    price = F.max(F.round(F.col("base") + F.col("l_discount") * 4 + F.col("l_tax") * 2, 2))
    leg = F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("event", 9), ("slot", 2), ("book", 9))))
    priced = line.repartition("event").join(F.broadcast(slots(spark).select("slot", "base")), "slot")  # 12 rows
    found = priced.groupBy("event", "slot", "book").agg(price.alias("odds"), F.max("ms").alias("observed_ms")).join(F.broadcast(slots(spark).drop("base")), "slot")
    return found.select("event", "slot", "book", "family", "market_type", "participant", "line_c", "outcome", "odds", "observed_ms", leg.alias("leg_id"))


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, slot: what ``quotes`` has prices of, repeated."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event"), (F.col("l_orderkey") % 12).cast("int").alias("slot"))
    return line.join(F.broadcast(slots(spark).select("slot")), "slot")  # 12 rows


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match, home, away, status of every order."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "P", "POSTPONED").otherwise("SCHEDULED")
    return o.select(F.col("o_orderkey").alias("match"), (F.col("o_orderkey") % 5).cast("int").alias("home"), (F.col("o_custkey") % 4).cast("int").alias("away"), status.alias("status"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source, started_ms, latency_ms, status of every event."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "DOWN").when(kind == "signup", "DEGRADED").otherwise("HEALTHY")
    return e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 10).alias("source"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"), F.floor(F.col("value") * 1000 + 0.5).alias("latency_ms"), status.alias("status"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type (together the series), at_ms, seq, price of every event."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), F.round(1 + F.col("value") / 100, 6).alias("price"))


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as two providers name them: id, provider, home, away, competition, start_ms."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # 25 nations
    return joined.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).cast("int").alias("provider"), F.col("n_name").alias("home"), F.col("c_mktsegment").alias("away"),
        F.col("o_orderpriority").alias("competition"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start_ms"),
    )


def priced(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Current prices with period and provenance: event, period, slot, book, odds, observed_ms, leg_id, status, confidence, suspended and the slot's columns.

    A returned line item is a price of the first half, others are of the whole match. A book's source is its last digit; the
    status is that of the source's last run. Confidence comes from the part's size, the smallest have none. ``lines``: some line items instead of all.
    """
    line = (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        F.col("l_partkey").alias("event"), F.when(F.col("l_returnflag") == "R", "FIRST_HALF").otherwise("FULL_TIME").alias("period"), (F.col("l_orderkey") % 12).cast("int").alias("slot"),
        F.col("l_suppkey").alias("book"), "l_discount", "l_tax", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"), (F.col("l_quantity") == 1).alias("suspended"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event"), F.when(F.col("p_size") > 3, F.round(0.77 + F.col("p_size") / 250, 3)).alias("confidence"))
    price = F.max(F.round(F.col("base") + F.col("l_discount") * 4 + F.col("l_tax") * 2, 2))
    leg = F.concat_ws(":", F.lpad(F.col("event").cast("string"), 9, "0"), F.substring("period", 1, 2), F.lpad(F.col("slot").cast("string"), 2, "0"), F.lpad(F.col("book").cast("string"), 9, "0"))
    # narrow rows, all of an event together: what follows groups within an event, so nothing else is shuffled
    rows = line.repartition("event").join(F.broadcast(slots(spark).select("slot", "base")), "slot")  # 12 rows
    found = rows.groupBy("event", "period", "slot", "book").agg(price.alias("odds"), F.max("ms").alias("observed_ms"), F.bool_and("suspended").alias("suspended"))
    status = runs(spark, sf_dir).groupBy("source").agg(F.max_by("status", F.struct("started_ms", "run_id")).alias("status"))  # ten rows
    found = found.join(F.broadcast(slots(spark).drop("base")), "slot").withColumn("source", F.col("book") % 10).join(F.broadcast(status), "source", "left")
    found = found.join(part.hint("shuffle_hash"), "event", "left")
    columns = ["event", "period", "slot", "book", "family", "market_type", "participant", "line_c", "outcome", "odds", "observed_ms", "suspended", "status", "confidence"]
    return found.select(*columns, leg.alias("leg_id"))


def joint_slots(spark: SparkSession) -> DataFrame:
    """The selections over periods, corners and cards: 24 rows."""
    return spark.createDataFrame(JOINT, "slot int, family string, period string, participant string, line_c int, outcome string, base double")


def joint_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, slot, odds, book: the best price of each of the joint selections, the first book among equal ones."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event"), (F.col("l_orderkey") % len(JOINT)).cast("int").alias("slot"), F.col("l_suppkey").alias("book"), "l_discount", "l_tax")
    priced = line.join(F.broadcast(joint_slots(spark).select("slot", "base")), "slot")  # 24 rows
    odds = F.round(F.col("base") + F.col("l_discount") * 4 + F.col("l_tax") * 2, 2)
    best = priced.groupBy("event", "slot").agg(F.max(F.struct(odds.alias("odds"), (-F.col("book")).alias("book"))).alias("best"))
    return best.select("event", "slot", "best.odds", (-F.col("best.book")).alias("book"))
