"""Alerts raised by records that do not come.

A target that reports at least every so often is missed when the watermark, which is how
far event time is known to have come, passes its last record by more than the limit.  The
state of a target is the times of its records that the watermark has not settled; a timer
fires for a target that sends nothing more.  Records behind the watermark are too late and
change nothing, so the alerts do not depend on how records fall into batches as long as
none is later than the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MICROS = 1_000_000


def settle(times: list[int], told: bool, watermark: int, limit: int) -> tuple[list[int], bool, list[int]]:
    """(times still open, whether the first of them was told already, times after which nothing came in time)."""
    found = []
    while times and watermark > times[0] + limit:
        follows = times[1] if len(times) > 1 else None
        if not told and (follows is None or follows > times[0] + limit):
            found.append(times[0])
        if follows is None:
            return times, True, found
        times, told = times[1:], False
    return times, told, found


def missing(records: DataFrame, key: str, limit_seconds: int, delay: str, ts: str = "ts") -> DataFrame:
    """Stream of (key, last_seen, due): one row whenever a target was silent for longer than the limit.

    `records` is a stream with the key, text, and the time of each record.  A row comes
    when the watermark, the latest time less `delay`, has passed `due`.
    """
    limit = limit_seconds * _MICROS

    def watch(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, told = state.get if state.exists else ([], False)
        times = list(times)
        watermark = max(0, state.getCurrentWatermarkMs()) * 1000
        if not state.hasTimedOut:
            last = times[0] if times else None
            new = {int(t) for frame in frames for t in frame["micros"] if t >= watermark}
            times = sorted(new.union(times))
            told = told and times[0] == last
        times, told, found = settle(times, bool(told), watermark, limit)
        if times:
            state.update((times, told))
            if not told:
                state.setTimeoutTimestamp(max(watermark, times[0] + limit) // 1000 + 1)
        else:
            state.remove()
        if found:
            yield pd.DataFrame({"name": [name[0]] * len(found), "micros": found})

    timed = records.select(F.col(key).cast("string").alias("name"), F.col(ts).cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    alerts = timed.groupBy("name").applyInPandasWithState(
        watch, "name string, micros bigint", "times array<bigint>, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return alerts.select(
        F.col("name").alias(key),
        F.timestamp_micros("micros").alias("last_seen"),
        F.timestamp_micros(F.col("micros") + limit).alias("due"),
    )
