"""Mastery in event order: attempts wait until the watermark has passed them, so the order of arrival doesn't matter.

State is kept by student, since each key costs a frame and several calls a batch, however few rows it has. A student
buffers attempts and has a timer at the earliest of them. When the watermark comes to it, all
that it has passed are folded in the order of (time, id), each for its LO, and the rest stay. An attempt that comes when
its time has been passed isn't folded: it goes out marked ``late``, for a side table, as long as it isn't
older than ``kept`` besides. The buffer of a student holds what falls into ``delay``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.temporal import HIGH, LOW, PRIOR, RATE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries that are started within the block keep their state in RocksDB, which processors with timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class OrderedMastery(StatefulProcessor):
    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, is_correct boolean, lo_id string")
        self.folded = handle.getMapState("folded", "lo_id string", "n long, score double")

    def _passed(self, timers) -> int:
        """Microseconds up to which the watermark has come."""
        return (timers.getCurrentWatermarkInMs() + self.kept_ms) * 1000

    def _wake(self, rows: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000) - self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        come = pd.concat(list(rows))
        late = come[come["at"] <= passed]
        if len(late):
            yield _rows(key, [(lo, None, None, at, i, True) for lo, at, i in zip(late["lo_id"], late["at"], late["id"], strict=True)])
        come = come[come["at"] > passed]
        if len(come):
            rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            rows += [(int(a), int(i), bool(c), lo) for a, i, c, lo in zip(come["at"], come["id"], come["is_correct"], come["lo_id"], strict=True)]
            self.waiting.put(rows)
            self._wake(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        folded: dict[str, tuple[int, float]] = {}
        out = []
        for at, i, right, lo in ready:
            if lo not in folded:
                folded[lo] = self.folded.getValue((lo,)) if self.folded.containsKey((lo,)) else (0, PRIOR)
            n, score = folded[lo]
            n, score = folded[lo] = n + 1, min(HIGH, max(LOW, score + RATE * (float(right) - score)))
            out.append((lo, n, score, at, i, False))
        for lo, state in folded.items():
            self.folded.updateValue((lo,), state)
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._wake(rest)
        if out:
            yield _rows(key, out)


def _rows(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(*key, *r) for r in rows], columns=["student_id", "lo_id", "n", "score", "at", "id", "late"])
    return out.astype({"n": "Int64", "score": "Float64"})


def ordered_mastery(attempts: DataFrame, delay: str = "1 hour", kept_days: int = 3650) -> DataFrame:
    """(student_id, lo_id, n, score, system_from, id, late) of a stream of attempts (id, student_id, lo_id, is_correct, attempted_at).

    ``delay`` is how long an attempt may be overtaken; those that come later yet, but within ``kept_days``, are late rows
    without n and score. What is still waiting when a stream stops is in its state.
    """
    at = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    seen = attempts.select("student_id", "lo_id", "id", "is_correct", at.alias("at"), F.col("attempted_at").cast("timestamp").alias("_seen")).withWatermark("_seen", f"{delay} {kept_days} days")
    schema = "student_id long, lo_id string, n long, score double, at long, id long, late boolean"
    out = seen.groupBy("student_id").transformWithStateInPandas(OrderedMastery(kept_days * DAY_MS), schema, "Append", "EventTime")
    return out.select("student_id", "lo_id", "n", "score", F.timestamp_micros("at").cast("timestamp_ntz").alias("system_from"), "id", "late")
