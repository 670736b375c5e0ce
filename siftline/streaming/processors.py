"""Keyed stream state with values and timers: time-to-live deduplication, idle keys, and breakers.

A processor keeps a few numbers for each key in the state store and drops them by an event-time timer once no later event
can need them, so the store holds active keys only.  Of the rows of a key in a micro-batch it holds the times and ids
that it must order, 16 bytes a row; other columns are not sent to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """The columns of all rows of a key as arrays, in order of the first two."""
    parts = [[batch[c].to_numpy() for c in columns] for batch in rows]
    arrays = [np.concatenate(p) for p in zip(*parts)]
    order = np.lexsort((arrays[1], arrays[0]))
    return [a[order] for a in arrays]


def _replace_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class TtlAnchors(StatefulProcessor):
    """First event of a key, then each first one later than the time to live after the last anchor.  State: the anchor, dropped
    when the watermark has passed the time to live."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, ids = _ordered(rows, ["at_us", "row_id"])
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        kept = []
        at = 0
        while at < len(times):  # the next anchor is found by a search, not row by row
            if anchor is not None:
                at = max(at, int(np.searchsorted(times, anchor + self.ttl_us, "right")))
                if at == len(times):
                    break
            anchor = int(times[at])
            kept.append(at)
        if kept:
            self.anchor.update((anchor,))
            _replace_timer(self.handle, (anchor + self.ttl_us) // 1000 + 1)
            yield pd.DataFrame({"key": [key[0]] * len(kept), "id": ids[kept], "at": times[kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.anchor.clear()
        return iter([])

    def close(self) -> None:
        pass


class IdleKeys(StatefulProcessor):
    """A row for each silence of a key that is longer than ``idle_us``: its last event and the number of events since the silence
    before.  A silence is known by the next event, or else once the watermark has passed it, and the state is dropped then."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([batch["at_us"].to_numpy() for batch in rows]))
        last, count = self.seen.get() if self.seen.exists() else (int(times[0]), 0)
        before = np.concatenate(([last], times[:-1]))
        ends = np.flatnonzero(times - before > self.idle_us)  # silences before these events
        held = np.diff(np.concatenate(([0], ends, [len(times)])))
        held[0] += count
        self.seen.update((max(last, int(times[-1])), int(held[-1])))
        _replace_timer(self.handle, (max(last, int(times[-1])) + self.idle_us) // 1000 + 1)
        if len(ends):
            yield pd.DataFrame({"key": [key[0]] * len(ends), "at": before[ends], "events": held[:-1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, count = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"key": [key[0]], "at": [last], "events": [count]})

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """State of a key's breaker at each of its calls, folded by ``step`` (see ``sessions.circuit``).  A breaker that has not been
    called for ``idle_us`` after its cool-down starts again as it would go on: its state is dropped where ``forgets`` says so."""

    def __init__(self, start: dict, step: Callable, idle_us: int, forgets: Callable[[dict], bool]):
        self.start, self.step, self.idle_us, self.forgets = start, step, idle_us, forgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", ", ".join(f"{name} double" for name in self.start))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, ids, failed = _ordered(rows, ["at_us", "row_id", "bad"])
        state = dict(zip(self.start, self.state.get())) if self.state.exists() else dict(self.start)
        out = []
        for at, bad in zip((times / 1e6).tolist(), failed.tolist()):
            state, made = self.step(state, at, bad)
            out.append(made)
        self.state.update(tuple(state.values()))
        if self.forgets(state):
            _replace_timer(self.handle, (int(times[-1]) + self.idle_us) // 1000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "state": [m[0] for m in out], "called": [m[1] for m in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.forgets(dict(zip(self.start, self.state.get()))):
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _narrow(events: DataFrame, key: str, ts: str, lateness: str, **columns: str) -> DataFrame:
    named = [F.col(source).alias(name) for name, source in columns.items()]
    return events.withWatermark(ts, lateness).select(F.col(key).alias("of_key"), F.col(ts).alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), *named)


def _kind(events: DataFrame, column: str) -> str:
    return dict(events.dtypes)[column]


def ttl_anchors(events: DataFrame, key: str, ts: str, ident: str, ttl_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Stream of ``key, id, at`` (microseconds) of the events that count as new."""
    rows = _narrow(events, key, ts, lateness, row_id=ident)
    return rows.groupBy("of_key").transformWithStateInPandas(
        TtlAnchors(ttl_seconds * 1_000_000), f"key {_kind(events, key)}, id {_kind(events, ident)}, at long", "append", "eventtime"
    )


def idle_keys(events: DataFrame, key: str, ts: str, idle_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Stream of ``key, at, events`` of keys that have been silent for ``idle_seconds``."""
    rows = _narrow(events, key, ts, lateness)
    return rows.groupBy("of_key").transformWithStateInPandas(IdleKeys(idle_seconds * 1_000_000), f"key {_kind(events, key)}, at long, events long", "append", "eventtime")


def breakers(events: DataFrame, key: str, ts: str, ident: str, failed: str, start: dict, step: Callable, idle_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Stream of ``key, id, state, called`` of every call; a closed breaker without failures is forgotten when idle."""
    rows = _narrow(events, key, ts, lateness, row_id=ident, bad=failed)
    fresh = {name: float(value) for name, value in start.items()}
    forgets = lambda state: state["mode"] == fresh["mode"] and state["count"] == fresh["count"]
    return rows.groupBy("of_key").transformWithStateInPandas(
        Breaker(fresh, step, idle_seconds * 1_000_000, forgets), f"key {_kind(events, key)}, id {_kind(events, ident)}, state string, called boolean", "append", "eventtime"
    )


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that timers need, for streams started within; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all input there is, into a table under ``folder`` (which the executors share), and read the table."""
    spark = stream.sparkSession
    with rocks_state(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/table")
        query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
