"""Keyed state against the same rows in one batch."""

import random

import pytest

from quoteloom.operators import history
from quoteloom.sources import binding
from quoteloom.streaming import episodes

SF_DIR = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAP = 3 * 86_400_000
COLUMNS = ["user_id", "event_type", "at_ms", "seq", "price"]


@pytest.mark.parametrize("split,late", [("in order", "1 hours"), ("shuffled", "4000 days"), ("one row late", "10 days")])
def test_episodes_equal_the_batch(spark, tmp_path, split, late):
    rows = [tuple(r) for r in binding.series(spark, SF_DIR).where("user_id < 12").select(COLUMNS).collect()]
    rows.sort(key=lambda r: (r[2], r[3]))
    rng = random.Random(3)
    if split == "shuffled":
        rng.shuffle(rows)
    if split == "one row late":
        rows = [r for _, r in sorted((i + rng.randrange(4), r) for i, r in enumerate(rows))]
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(3))})
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])] + [[(999, "end", max(r[2] for r in rows) + 10**12, 0, 0.0)], [(999, "end", max(r[2] for r in rows) + 10**12 + 1, 1, 0.0)]]
    for batch in batches:
        spark.createDataFrame(batch, "user_id long, event_type string, at_ms long, seq long, price double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema("user_id long, event_type string, at_ms long, seq long, price double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = episodes.episodes(source, GAP, late).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"file://{tmp_path}/out").where("user_id < 999")
    want = history.episodes(spark.createDataFrame(rows, "user_id long, event_type string, at_ms long, seq long, price double"), GAP)
    assert sorted(map(tuple, got.drop("disappeared_ms").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("disappeared_ms <> last_ms + 259200000").count() == 0
