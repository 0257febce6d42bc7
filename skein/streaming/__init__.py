"""Structured Streaming forms: debounce, tiers, freshness, throttles and once-only notices."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAST_MS, HEAVY_MS = 300, 1500
FLUSHED = "key string, tier string, last timestamp, events long"


def _debounced(tier: str, window_ms: int):
    def step(key, batches, state: GroupState):
        """Every event moves the key's deadline to its own time plus the window; at the deadline, or at
        an event past it, the key is flushed."""
        last, n = state.get if state.exists else (0, 0)
        flushed = []
        if state.hasTimedOut:
            flushed.append((last, n))
            n = 0
        for ts in sorted(int(t.value // 1000) for pdf in batches for t in pdf["ts"]) if not state.hasTimedOut else ():
            if n and ts - last >= window_ms * 1000:
                flushed.append((last, n))
                n = 0
            last, n = max(last, ts) if n else ts, n + 1
        due = last // 1000 + window_ms
        mark = state.getCurrentWatermarkMs()
        if n and mark and due <= mark:  # nothing earlier can come
            flushed.append((last, n))
            n = 0
        if n:
            state.update((last, n))
            state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        if flushed:
            yield pd.DataFrame({"key": key[0], "tier": tier, "last": [pd.Timestamp(t, unit="us") for t, _ in flushed], "events": [c for _, c in flushed]})

    return step


def debounce(events: DataFrame, window_ms: int = FAST_MS, tier: str = "fast", delay: str = "0 seconds") -> DataFrame:
    """(key, tier, last, events) of a stream (key, ts): a key is flushed once it has been quiet for the window, by event time."""
    keyed = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return keyed.groupBy("key").applyInPandasWithState(_debounced(tier, window_ms), FLUSHED, "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


class Debouncer(StatefulProcessor):
    """Processing-time debounce with two deadlines a key: fast, then heavy."""

    def __init__(self, fast_ms: int = FAST_MS, heavy_ms: int = HEAVY_MS):
        self.fast_ms, self.heavy_ms = fast_ms, heavy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, n long")

    def handleInputRows(self, key, rows, timerValues):
        now, n = timerValues.getCurrentProcessingTimeInMs(), sum(len(r) for r in rows)
        if self.last.exists():
            at, before = self.last.get()
            for due in (at + self.fast_ms, at + self.heavy_ms):
                self.handle.deleteTimer(due)
            n += before
        self.last.update((now, n))
        self.handle.registerTimer(now + self.fast_ms)
        self.handle.registerTimer(now + self.heavy_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, n = self.last.get()
        heavy = expiredTimerInfo.getExpiryTimeInMs() >= at + self.heavy_ms
        if heavy:
            self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "tier": ["heavy" if heavy else "fast"], "last": [pd.Timestamp(at, unit="ms")], "events": [n]})

    def close(self) -> None:
        pass


def two_tier(events: DataFrame, fast_ms: int = FAST_MS, heavy_ms: int = HEAVY_MS) -> DataFrame:
    """Flushes of both tiers by processing time; needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(Debouncer(fast_ms, heavy_ms), FLUSHED, "append", "ProcessingTime")


def freshness(flushes: DataFrame, now: float | None = None) -> DataFrame:
    """(key, freshness): recomputing after a fast flush, fresh after a heavy one; the latest counts. A batch frame."""
    last = flushes.groupBy("key").agg(F.max_by("tier", F.struct("last", F.col("tier") == "heavy")).alias("tier"))
    return last.select("key", F.when(F.col("tier") == "heavy", "fresh").otherwise("recomputing").alias("freshness"))


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key of a stream; keys are kept for ever, as a session's notice is."""
    return events.dropDuplicates(keys)


def once_within(events: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """The same, forgetting keys after the horizon."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def refresh(stream: DataFrame, tiers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a query that hands each micro-batch's flushes of a tier to that tier's handler."""

    def batch(frame: DataFrame, epoch: int) -> None:
        for tier, handle in tiers.items():
            own = frame.where(F.col("tier") == tier)
            if not own.isEmpty():
                handle(own, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a JSON log; Spark's file sink rolls files and commits each batch once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def live(rows: DataFrame, expiry: str, now: int) -> DataFrame:
    """Rows whose expiry lies ahead: what a TTL leaves."""
    return rows.where(F.col(expiry) > now)


def cached(entries: DataFrame, version: str, endpoint: str, now: int, ttl: int = 3600) -> DataFrame:
    """entries (version, endpoint, written, ...) with `miss`: null where an entry can be served."""
    miss = F.when(F.col("version") != version, "version").when(F.col("endpoint") != endpoint, "endpoint").when(F.col("written") > now, "future").when(F.greatest(F.lit(now) - F.col("written"), F.lit(0)) > ttl, "stale")
    return entries.withColumn("miss", miss)
