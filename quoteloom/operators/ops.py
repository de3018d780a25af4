"""Operational operators: pages, cursors, alerts, token buckets, health, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cursor(value: Column, row_id: Column) -> Column:
    """An opaque, URL-safe cursor of the last row of a page."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(value.cast("string").alias("v"), row_id.cast("string").alias("id"))).cast("binary")), "+/\n\r", "-_"), F.lit("="))


def page(df: DataFrame, order: str, row_id: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """A keyset page with one more row to tell whether there are others; ``after`` is the last row's (value, id)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    if after is not None:
        value, last = F.lit(after[0]), F.lit(after[1])
        beyond = F.col(order) < value if descending else F.col(order) > value
        tie = F.col(row_id) < last if descending else F.col(row_id) > last
        df = df.where(beyond | ((F.col(order) == value) & tie))
    by = [F.col(order).desc(), F.col(row_id).desc()] if descending else [F.col(order), F.col(row_id)]
    return df.orderBy(*by).limit(limit + 1)


def folded(rows: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """What ``step(state, row)`` gives for the rows of each key in order: it returns (state, tuple or None), from state None on.

    Rows come sorted, in batches, and only the state goes from one to the next, so a key may have any number of them.
    ``schema`` names the columns of the tuples.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in [*keys, *order]]
            for row in zip(*columns):
                if key != row[: len(keys)]:
                    key, state = row[: len(keys)], None
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return rows.select(*keys, *order).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def alert_events(runs: DataFrame, hysteresis: int = 1, renotify_ms: int = 1_800_000, least: int = 1) -> DataFrame:
    """Firing and resolved events of each source's runs in order: the alert state machine as an ordered fold.

    Severity is 1 for DEGRADED and 2 for DOWN; below ``least`` nothing is told. A healthy run resets the state, so each
    stretch of bad runs is folded on its own, with the healthy run that ends it.
    """
    level = F.when(F.col("status") == "DOWN", 2).when(F.col("status") == "DEGRADED", 1).otherwise(0)
    order = ["started_ms", "run_id", "level"]
    before = Window.partitionBy("source").orderBy(*order)
    rows = runs.select("source", "started_ms", "run_id", level.alias("level"))
    healthy = F.when(F.col("level") == 0, 1).otherwise(0)
    rows = rows.withColumn("session", F.sum(healthy).over(before.rowsBetween(Window.unboundedPreceding, 0)) - healthy).withColumn("last", F.lag("level", 1, 0).over(before))
    rows = rows.where("level > 0 or last > 0")

    def step(state, row):
        source, _, at, run_id, level = row
        streak, active, told, severity, told_at = state or (0, False, False, 0, 0)
        streak = streak + 1 if level > 0 else 0
        fires = level > 0 and streak >= max(1, hysteresis)
        late = renotify_ms > 0 and at is not None and told_at is not None and at - told_at >= renotify_ms
        tells = fires and level >= least and (not active or not told or late or level > severity)
        if tells:
            return (streak, True, True, level, at), (source, run_id, "FIRING", level)
        if fires and active:
            return (streak, True, told, severity, told_at), None
        return (streak, fires, False, 0, 0), (source, run_id, "RESOLVED", level) if active and told and not fires else None

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    return folded(rows, ["source", "session"], order, step, f"source {kinds['source']}, run_id {kinds['run_id']}, kind string, severity int")


def token_bucket(requests: DataFrame, capacity: int, per_second: int) -> DataFrame:
    """Which requests of a source a bucket lets through; tokens are counted in thousandths, so the fold is exact.

    A gap that fills an empty bucket resets it, so what lies between two such gaps is folded on its own.
    """
    full = capacity * 1000
    before = Window.partitionBy("source").orderBy("started_ms", "run_id")
    gap = F.col("started_ms") - F.lag("started_ms").over(before)
    rows = requests.select("source", "started_ms", "run_id").withColumn("refilled", F.when(gap * per_second >= full, 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("refilled").over(before.rowsBetween(Window.unboundedPreceding, 0)))

    def step(state, row):
        source, _, at, run_id = row
        tokens, last = state or (full, None)
        filled = tokens if at is None or last is None else min(full, tokens + (at - last) * per_second)
        ok = filled >= 1000
        return (filled - 1000 if ok else filled, at), (source, run_id, ok)

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return folded(rows, ["source", "session"], ["started_ms", "run_id"], step, f"source {kinds['source']}, run_id {kinds['run_id']}, allowed boolean")


def health(status: Column, age_ms: Column, stale_ms: int) -> Column:
    """Health of a worker by its last cycle."""
    name = F.upper(F.trim(status))
    known = F.when(name == "DEGRADED", "degraded").when(name == "DOWN", "down").when(name == "ERROR", "error").when(~name.isin("OK", "HEALTHY") | name.isNull(), "starting")
    return F.coalesce(known, F.when(age_ms >= stale_ms, "stale").otherwise("ok"))


def retention(df: DataFrame, at: str, now_ms: Column, days: int, batch: int, batches: int) -> DataFrame:
    """What a bounded prune would take: rows before the cutoff, batches needed, rows taken, whether more are left."""
    cutoff = now_ms - days * 86_400_000
    old = df.agg(F.count_if(F.col(at) < cutoff).alias("eligible"))
    taken = F.least(F.col("eligible"), F.lit(batch * batches))
    return old.select("eligible", F.ceil(taken / batch).alias("batches"), taken.alias("taken"), (F.col("eligible") > taken).alias("more"))


def throttled(df: DataFrame, keys: list[str], at: str, row_id: str, every_ms: int) -> DataFrame:
    """Rows at least ``every_ms`` after the row before of their key, and the first."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, row_id))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(at) - F.col("_before") >= every_ms)).drop("_before")
