"""Dropping repeated messages, by event time or by a window of keys."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What makes two messages the same.
KEY = ("mmsi", "timestamp", "lat", "lon")


def dedup_within_watermark(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Messages without repeats that come within ``delay``; state is dropped behind the watermark."""
    return messages.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(KEY))


class RollingKeys:
    """The last ``size`` keys, first in first out; a repeat doesn't refresh its key's place."""

    def __init__(self, size: int = 10_000):
        self.size, self.keys = size, OrderedDict()

    def seen(self, key: tuple) -> bool:
        if key in self.keys:
            return True
        self.keys[key] = None
        if len(self.keys) > self.size:
            self.keys.popitem(last=False)
        return False


def dedup_rolling(messages: DataFrame, size: int = 10_000, by: str = "source", order: str = "timestamp") -> DataFrame:
    """Exact count-based dedup of a stream, keyed by ``by``; the state is the window of keys, at most ``size`` of them."""
    names = list(KEY)
    columns = messages.columns

    def step(key, frames: Iterator, state):
        import pandas as pd

        held = RollingKeys(size)
        if state.exists:
            held.keys = OrderedDict((tuple(k.split("\x1f")), None) for k in state.get[0])
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        keep = [not held.seen(tuple(map(str, k))) for k in rows[names].itertuples(index=False)]
        state.update((["\x1f".join(k) for k in held.keys],))
        yield rows[keep][columns]

    return messages.groupBy(by).applyInPandasWithState(step, messages.schema, "keys array<string>", "append", "NoTimeout")


def compact(batch: DataFrame, arrival: str | None = None) -> DataFrame:
    """The last row of each key by arrival, in order of (timestamp, mmsi)."""
    came = F.col(arrival) if arrival else F.monotonically_increasing_id()
    rows = batch.withColumn("_came", came)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*batch.columns), "_came").alias("_row"))
    return last.select("_row.*").sortWithinPartitions("timestamp", "mmsi") if batch.isStreaming else last.select("_row.*").orderBy("timestamp", "mmsi")
