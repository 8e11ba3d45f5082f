"""Snapshots of chat sessions: built at a session's first request and given again to the later ones.

A cache holds a bounded number of sessions. A snapshot lives for ``ttl_ms``; after that the next request builds a
new one. When there are too many, those that were built first go. Requests are taken in the order of (time, id)
within a micro-batch; timers take expired snapshots out of the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_MS, MAX_SESSIONS = 3 * 60 * 60 * 1000, 200
SCHEMA = "cache string, id long, session string, at_ms long, context string, built boolean"
#: A micro-batch's requests of one cache wait for their order as Arrow columns (some 50 bytes a request, not 500 as objects); so many at a time are answered.
REQUEST, ROWS = pa.schema([("id", pa.int64()), ("session", pa.large_string()), ("at_ms", pa.int64()), ("context", pa.large_string())]), 10_000


class Snapshots:
    """The sessions of one cache by the time they were built (ties: by session), the earliest first."""

    def __init__(self, held: dict[str, tuple[int, str]], ttl_ms: int, most: int):
        self.held, self.ttl_ms, self.most = dict(sorted(held.items(), key=lambda kv: (kv[1][0], kv[0]))), ttl_ms, most

    def request(self, session: str, at: int, context: str) -> tuple[str, bool]:
        """The snapshot that a request gets, and whether it was built for it."""
        hit = self.held.get(session)
        if hit and at - hit[0] < self.ttl_ms:
            return hit[1], False
        self.held.pop(session, None)
        self.held[session] = (at, context)
        while len(self.held) > self.most:
            del self.held[next(iter(self.held))]
        return context, True


class SessionCache(StatefulProcessor):
    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "at long, context string")

    def _read(self) -> dict[str, tuple[int, str]]:
        return {k[0]: (v[0], v[1]) for k, v in self.sessions.iterator()} if self.sessions.exists() else {}

    def _write(self, before: dict, after: dict) -> None:
        for s in before.keys() - after.keys():
            self.sessions.removeKey((s,))
        for s, v in after.items():
            if before.get(s) != v:
                self.sessions.updateValue((s,), v)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after:
            self.handle.registerTimer(min(at for at, _ in after.values()) + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._read()
        cache = Snapshots(before, self.ttl_ms, self.most)
        come = pa.Table.from_batches((pa.RecordBatch.from_pandas(r[list(REQUEST.names)], REQUEST, preserve_index=False) for r in rows), REQUEST).combine_chunks()
        order = pc.sort_indices(come, [("at_ms", "ascending"), ("id", "ascending")])
        for at in range(0, len(order), ROWS):
            out = [(key[0], r["id"], r["session"], r["at_ms"], *cache.request(r["session"], r["at_ms"], r["context"])) for r in come.take(order[at : at + ROWS]).to_pylist()]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        self._write(before, cache.held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, now = self._read(), timerValues.getCurrentWatermarkInMs()
        self._write(before, {s: v for s, v in before.items() if v[0] + self.ttl_ms > now})
        return iter([])


def snapshot_stream(requests: DataFrame, ttl_ms: int = TTL_MS, most: int = MAX_SESSIONS, delay: str = "1 hour") -> DataFrame:
    """Requests (cache, id, session, at, context) of a stream with the snapshot that each gets."""
    seen = requests.select("cache", "id", "session", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), "context", F.col("at").cast("timestamp").alias("_seen")).withWatermark("_seen", delay)
    return seen.groupBy("cache").transformWithStateInPandas(SessionCache(ttl_ms, most), SCHEMA, "Append", "EventTime")


def snapshot_batch(requests: DataFrame, ttl_ms: int = TTL_MS, most: int = MAX_SESSIONS) -> DataFrame:
    """The same over a whole log. A cache is one sequence, so its requests pass through one task, in order; none holds more than its snapshots."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = None, Snapshots({}, ttl_ms, most)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["cache"] != now:
                    now, cache = row["cache"], Snapshots({}, ttl_ms, most)
                out.append((now, row["id"], row["session"], row["at_ms"], *cache.request(row["session"], row["at_ms"], row["context"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=names)

    rows = requests.select("cache", "id", "session", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), "context")
    return rows.repartition("cache").sortWithinPartitions("cache", "at_ms", "id").mapInArrow(run, SCHEMA)
