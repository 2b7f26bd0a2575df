"""The rate limit and the expiring cache as stateful streams.

The events of a key in a micro-batch are put in order before they are folded. State goes once the watermark has
passed the time from which it cannot matter any more; events that are later than the watermark allows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import expiring, sliding_log


def _stream(events: DataFrame, key: str, time: str, order: str, keeps: float, late: float, out: str, load: Callable, save: Callable, state_type: str) -> DataFrame:
    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step = load(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["seconds", order])
        flags = [step(float(now)) for now in rows["seconds"]]
        state.update((save(step),))
        # no earlier than the watermark, which may have passed the group's last event
        state.setTimeoutTimestamp(max(int((rows["seconds"].iloc[-1] + keeps) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), out: flags})

    types = dict(events.dtypes)
    timed = events.select(key, order, F.col(time).cast("timestamp").alias("event_time")).withWatermark("event_time", f"{late} seconds")
    timed = timed.withColumn("seconds", F.unix_micros("event_time") / 1e6)
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, {out} boolean", state_type, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(events: DataFrame, key: str, time: str, order: str, limit: int = 100, window: float = 60.0, late: float = 600.0) -> DataFrame:
    """key, order, allowed for each event as it comes; the state is the log of allowed times of the last window."""
    return _stream(events, key, time, order, window, late, "allowed", lambda log: sliding_log(limit, window, log), lambda step: list(step.log), "log array<double>")


def cache_hits_stream(events: DataFrame, key: str, time: str, order: str, ttl: float = 3600.0, late: float = 600.0) -> DataFrame:
    """key, order, hit for each access as it comes; the state is when the stored value expires."""
    ttl = ttl or 3600.0
    return _stream(events, key, time, order, ttl, late, "hit", lambda expiry: expiring(ttl) if expiry is None else expiring(ttl, expiry), lambda step: step.expiry(), "expiry double")
