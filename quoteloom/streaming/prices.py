"""Change-only price streams: the batch rule, kept as state of each series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

OUT = "user_id long, event_type string, at_ms long, seq long, price double"


def changes(stream: DataFrame) -> DataFrame:
    """The observations of a stream (user_id, event_type, at_ms, seq, price) that differ from the one before in their series, and the first.

    State is the last price and place of each series; within a batch rows are ordered by time, and a row older than
    the state is left out, as the stored price is newer.
    """

    def run(key, frames, state):
        last, at, seq = state.get if state.exists else (None, -1, -1)
        for pdf in frames:
            pdf = pdf.sort_values(["at_ms", "seq"])
            keep = []
            for t, s, p in zip(pdf["at_ms"], pdf["seq"], pdf["price"], strict=True):
                newer = (t, s) > (at, seq)
                keep.append(newer and (last is None or p != last))
                if newer:
                    last, at, seq = float(p), int(t), int(s)
            yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "at_ms": pdf["at_ms"], "seq": pdf["seq"], "price": pdf["price"]})[keep]
        state.update((last, at, seq))

    return stream.groupBy("user_id", "event_type").applyInPandasWithState(run, OUT, "price double, at_ms long, seq long", "append", "NoTimeout")
