"""Episodes of a stream as keyed state: counted on while rows come, swept by a timer when none have come for too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, event_type string, episode long, first_ms long, last_ms long, detected long, opened double, closed double, duration_ms long, disappeared_ms long"


class Episodes(StatefulProcessor):
    """One key's open episode, and the rows that the watermark hasn't passed yet.

    Rows wait in a list until the watermark shows that no earlier one can come, so their order within and between batches
    doesn't matter. A timer is set for the first of them, and for the moment from which on a further row would begin a new episode:
    then the open one is given out, with that moment as when it disappeared. A row at or before the last
    watermark this key has acted on comes too late and is left out.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, seq long, price double")
        self.open = handle.getValueState("open", "episode long, first_ms long, last_ms long, detected long, opened double, closed double")
        self.after = handle.getValueState("after", "acted_ms long, episodes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        acted = self.after.get()[0] if self.after.exists() else -(1 << 62)
        first = None
        for pdf in rows:
            some = [(int(a), int(s), float(p)) for a, s, p in zip(pdf["at_ms"], pdf["seq"], pdf["price"], strict=True) if a > acted]
            if some:
                self.waiting.appendList(some)
                first = min(some)[0] if first is None else min(first, min(some)[0])
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        open_ = tuple(self.open.get()) if self.open.exists() else None
        number = self.after.get()[1] if self.after.exists() else 0
        done = []
        for at, _, price in ready:
            if open_ is not None and at - open_[2] > self.gap_ms:
                done.append(open_)
                open_ = None
            if open_ is None:
                open_, number = (number, at, at, 1, price, price), number + 1
            else:
                open_ = (*open_[:2], at, open_[3] + 1, open_[4], price)
        if open_ is not None and now > open_[2] + self.gap_ms:
            done.append(open_)
            open_ = None
        self.after.update((now, number))
        if open_ is None:
            self.open.clear()
        else:
            self.open.update(open_)
            self.handle.registerTimer(open_[2] + self.gap_ms + 1)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        elif rows:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], key[1], *e, e[2] - e[1], e[2] + self.gap_ms) for e in done], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """The finished episodes of a stream (user_id, event_type, at_ms, seq, price) whose rows come at most ``late`` after later ones.

    Equal to ``history.episodes`` over the same rows, however they are split into batches, with disappeared_ms as
    well. Needs the RocksDB state store.
    """
    timed = stream.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("user_id", "event_type").transformWithStateInPandas(statefulProcessor=Episodes(gap_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
