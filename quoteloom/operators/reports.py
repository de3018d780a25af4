"""Reports on episodes, cycles and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def false_positive_report(episodes: DataFrame, top: int = 5) -> DataFrame:
    """section, name, n, avg_ms: episodes by latest status with their mean duration, and the ``top`` rejection reasons.

    episodes: status, reason (null without one), duration_ms. Equal counts are ordered by name.
    """
    by_status = episodes.groupBy(F.lit("status").alias("section"), F.col("status").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"))
    reasons = episodes.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    most = reasons.orderBy(F.col("n").desc(), "reason").limit(top)
    return by_status.unionByName(most.select(F.lit("reason").alias("section"), F.col("reason").alias("name"), "n", F.lit(None).cast("double").alias("avg_ms")))


def cycle_status(outcomes: DataFrame, keys: list[str], error: Column | None = None) -> DataFrame:
    """The status all sources of a cycle share, or DEGRADED: sources that differ, or an error of the detection."""
    failed = F.lit(False) if error is None else F.bool_or(error)
    same = (F.min("status") == F.max("status")) & ~F.coalesce(failed, F.lit(False))
    return outcomes.groupBy(*keys).agg(F.when(same, F.min("status")).otherwise("DEGRADED").alias("status"))


def least_confidence(rows: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """The smallest confidence of each key, if every row states one."""
    whole = F.count("*") == F.count(confidence)
    return rows.groupBy(*keys).agg(F.when(whole, F.min(confidence)).alias("confidence"))


def newest(rows: DataFrame, at: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return rows.orderBy(F.col(at).desc(), F.col(row_id).desc()).limit(n)


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Each parent with the sorted array of its children's ``fields``; an empty one without children.

    Children are gathered by parent, so a parent's own are to fit in a row: links, books or legs of one event.
    """
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def new_keys(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The keys to add to a dimension: those seen and not stored, each once."""
    return seen.select(key).where(F.col(key).isNotNull()).distinct().join(stored.select(key), key, "left_anti")


def gone(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``before`` that ``now`` no longer has."""
    return before.select(*keys).distinct().join(now.select(*keys), keys, "left_anti")


def decode_cursor(text: Column) -> Column:
    """(v, id) of an opaque cursor, or null if it is malformed."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4) * 4, F.lit("="))
    good = text.rlike("^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1)
    read = F.from_json(F.when(good, F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8")), "v string, id string")
    return F.when(read["v"].isNotNull() & read["id"].isNotNull(), read)
