"""Detection over a stream of prices: each micro-batch is a run, and its tables are one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detection
from ..sources.versions import Versions

#: Whole snapshots; earlier ones aren't needed once the next is committed. Opportunities and their legs stay.
SNAPSHOTS = ("prices", "episodes")


def current(before: DataFrame | None, updates: DataFrame) -> DataFrame:
    """The last price of every leg; of prices of one time the highest."""
    rows = updates if before is None else before.unionByName(updates)
    rest = [c for c in rows.columns if c != "leg_id"]
    last = F.max_by(F.struct(*rest), F.struct("observed_ms", "odds")).alias("last")
    return rows.groupBy("leg_id").agg(last).select("leg_id", "last.*").select(*rows.columns)


def run_batch(updates: DataFrame, number: int, versions: Versions, slots: DataFrame, policy: detection.Policy) -> bool:
    """One run over the prices so far and ``updates``; False if the run of this number is committed already.

    The time of a run is that of the last price, so it is the same whenever the run is repeated.
    """
    if number in versions.committed():
        return False
    spark, last = versions.spark, versions.last_before(number)
    before = None if last is None else versions.read("prices", last)
    prices = versions.write("prices", number, current(before, updates))
    now = prices.agg(F.max("observed_ms")).first()[0]
    policy = policy._replace(now_ms=policy.now_ms if now is None else now)
    found = versions.write("opportunities", number, detection.opportunities(detection.scanned(prices, slots, policy, only_open=True), policy))
    versions.write("legs", number, detection.legs_of(found))
    episodes = spark.createDataFrame([], detection.EPISODE) if last is None else versions.read("episodes", last)
    versions.write("episodes", number, detection.folded(episodes, found, policy.now_ms))
    versions.commit(number)
    for name in SNAPSHOTS:
        versions.expire(name, keep=2)
    return True


def detect(prices: DataFrame, root: str, slots: DataFrame, policy: detection.Policy, checkpoint: str) -> StreamingQuery:
    """Starts runs over a stream of prices (the columns of ``binding.priced``), with its tables below ``root``."""
    versions = Versions(prices.sparkSession, root)

    def run(batch: DataFrame, number: int) -> None:
        run_batch(batch, number, versions, slots, policy)

    return prices.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
