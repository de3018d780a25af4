"""Price series, episodes and reports on sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES = ["user_id", "event_type"]


def changes(series: DataFrame) -> DataFrame:
    """The observations that differ from the one before in their series, and the first."""
    before = F.lag("price").over(Window.partitionBy(*SERIES).orderBy("at_ms", "seq"))
    return series.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("price")))


def movement(series: DataFrame) -> DataFrame:
    """First, last, lowest and highest price of each series, difference and its share of the first (0 if that is 0)."""
    at = F.struct("at_ms", "seq")
    found = series.groupBy(*SERIES).agg(F.min_by("price", at).alias("first"), F.max_by("price", at).alias("last"), F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("points"))
    delta = F.col("last") - F.col("first")
    return found.withColumn("delta", F.round(delta, 6)).withColumn("share", F.round(F.when(F.col("first") == 0, 0.0).otherwise(delta / F.col("first")), 6))


def odds_history(series: DataFrame, event_type: str, from_ms: int, to_ms: int, limit: int) -> DataFrame:
    """Prices of one kind in an inclusive range, oldest first, at most ``limit``."""
    return series.where((F.col("event_type") == event_type) & F.col("at_ms").between(from_ms, to_ms)).orderBy("at_ms", "seq").limit(limit)


def episodes(series: DataFrame, gap_ms: int) -> DataFrame:
    """Runs of observations of a series without a gap longer than ``gap_ms``: number, first and last seen, count, duration."""
    own = Window.partitionBy(*SERIES).orderBy("at_ms", "seq")
    starts = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(own) > gap_ms).cast("int"), F.lit(0))
    numbered = series.withColumn("starts", starts).withColumn("episode", F.sum("starts").over(own))
    return numbered.groupBy(*SERIES, "episode").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count("*").alias("detected"), F.min_by("price", F.struct("at_ms", "seq")).alias("opened"), F.max_by("price", F.struct("at_ms", "seq")).alias("closed")).withColumn(
        "duration_ms", F.col("last_ms") - F.col("first_ms")
    )


def sweep(stored: DataFrame, active: DataFrame, now_ms: Column) -> DataFrame:
    """stored (user_id, event_type, last_ms, open) against the active keys: disappeared, restored, unchanged."""
    seen = active.select(*SERIES).distinct().withColumn("seen", F.lit(True))
    both = stored.join(seen, SERIES, "left")
    gone = F.col("seen").isNull() & F.col("open") & (F.col("last_ms") < now_ms)
    back = F.col("seen").isNotNull() & ~F.col("open")
    return both.select(*SERIES, F.when(gone, "disappeared").when(back, "restored").otherwise("unchanged").alias("change"))


def latency(runs: DataFrame) -> DataFrame:
    """Per source: runs, mean, smallest, largest and last latency, start of the last run; latest first."""
    at = F.struct("started_ms", "run_id")
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.max("started_ms").alias("last_run_ms"), F.max_by("latency_ms", at).alias("last_ms")
    )


def reliability(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source, also one without runs: counts by status, success rate (null without runs), nearest-rank p50 and p95, last run."""
    at = F.struct("started_ms", "run_id")
    found = runs.groupBy("source").agg(
        F.count("*").alias("runs"), *(F.count_if(F.col("status") == x).alias(x.lower()) for x in ("HEALTHY", "DEGRADED", "DOWN")),
        F.expr("percentile_disc(0.5) within group (order by latency_ms)").cast("long").alias("p50_ms"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("long").alias("p95_ms"),
        F.max_by("status", at).alias("last_status"), F.max_by("latency_ms", at).alias("last_ms"),
    )
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "healthy", "degraded", "down")}
    rate = F.round(F.try_divide(F.col("healthy"), F.col("runs")), 6).alias("success_rate")
    return sources.select("source").join(found, "source", "left").select("source", *counts.values(), rate, "p50_ms", "p95_ms", "last_status", "last_ms")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def false_positives(latest_status: DataFrame) -> DataFrame:
    """One row from each key's latest status: keys, verified, false positives and their rate."""
    bad = F.count_if(F.col("status").isin("DOWN", "DEGRADED"))
    return latest_status.agg(F.count("*").alias("episodes"), F.count_if(F.col("status") == "HEALTHY").alias("verified"), bad.alias("false_positives"), F.round(F.try_divide(bad, F.count("*")), 6).alias("rate"))


def rule_as_of(events: DataFrame, rules: DataFrame) -> DataFrame:
    """For each event the rule of its source with from <= at < to and the latest from; an open start counts as 0 in that order.

    rules: source, version, from_ms, to_ms; a rule book is a dimension of a few rows a source.
    """
    inside = (F.col("r.from_ms").isNull() | (F.col("r.from_ms") <= F.col("e.started_ms"))) & (F.col("r.to_ms").isNull() | (F.col("e.started_ms") < F.col("r.to_ms")))
    joined = events.alias("e").join(F.broadcast(rules).alias("r"), (F.col("e.source") == F.col("r.source")) & inside, "left")
    return joined.groupBy("e.run_id", "e.source", "e.started_ms").agg(F.max_by("r.version", F.struct(F.coalesce("r.from_ms", F.lit(0)), "r.version")).alias("version"))
