"""Continuous refresh, liveness and failure counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

WATCH_S = 60


def file_stream(spark: SparkSession, path: str, schema: str, most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def watch(stream: DataFrame, update: Callable[[DataFrame], Any], checkpoint: str, seconds: int | None = WATCH_S) -> StreamingQuery:
    """Run ``update`` on each batch; batches never overlap, a failed one is told and repeated on restart.

    Without ``seconds`` all that is there is worked off, then the query ends.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: update(df))
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def latest_beats(stream: DataFrame) -> DataFrame:
    """(id, last_heartbeat) as running maxima by instance."""
    return stream.groupBy("id").agg(F.max("ts").alias("last_heartbeat"))


def liveness(stream: DataFrame, timeout_s: int) -> DataFrame:
    """(id, last_heartbeat, status): 'alive' with each batch of beats, 'evicted' after ``timeout_s`` without any."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "last_heartbeat": [last], "status": ["evicted"]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(f.ts.max()) for f in frames if len(f))])
        state.update((last,))
        state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame({"id": [key[0]], "last_heartbeat": [last], "status": ["alive"]})

    return stream.groupBy("id").applyInPandasWithState(step, "id long, last_heartbeat long, status string", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Statuses(StatefulProcessor):
    """The last beat of an instance, and two timers after it: one makes it stale, one evicts it and ends its state."""

    def __init__(self, stale_s: int, evicted_s: int):
        # an instance is stale from stale_s on, and evicted beyond evicted_s
        self.after = {"stale": stale_s * 1000, "evicted": evicted_s * 1000 + 1}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _told(self, key: tuple, last: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "last_heartbeat": [last // 1000], "status": [status]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        last = max([*([] if known is None else [known]), *(int(f.ms.max()) for f in rows if len(f))])
        if last != known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            for wait in self.after.values():
                self.handle.registerTimer(last + wait)
            self.last.update((last,))
            yield self._told(key, last, "live")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        evicted = expiredTimerInfo.getExpiryTimeInMs() >= last + self.after["evicted"]
        if evicted:
            self.last.clear()
        yield self._told(key, last, "evicted" if evicted else "stale")

    def close(self) -> None:
        pass


def statuses(stream: DataFrame, stale_s: int = 30, evicted_s: int = 120, late: str = "0 seconds") -> DataFrame:
    """(id, last_heartbeat, status) with each change: 'live' with a later beat, then 'stale', then 'evicted', as the stream's own time goes on.

    ``stream`` has (id long, at timestamp); time is the latest beat of all, less ``late``, and beats behind it are left out.
    State and timers are kept by the query's checkpoint, so a stopped query goes on where it was. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass). Of several rows of an instance in one batch the later status holds.
    """
    beats = stream.select("id", "at").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return beats.groupBy("id").transformWithStateInPandas(Statuses(stale_s, evicted_s), "id long, last_heartbeat long, status string", "append", "eventTime")


def failure_counts(stream: DataFrame, least: int = 3) -> DataFrame:
    """(path, failures, ignored): failures since the last success; ``least`` of them make a path ignored."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for f in frames:
            for ok in f.sort_values("ts").ok:
                n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"path": [key[0]], "failures": [n], "ignored": [n >= least]})

    return stream.groupBy("path").applyInPandasWithState(step, "path string, failures long, ignored boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows; a missing extra is empty."""
    df.withColumn("extra", F.coalesce("extra", F.lit(""))).write.mode("append").parquet(path)
