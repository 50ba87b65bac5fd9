"""Alerts by event time, with timers: rows that come late are placed where they belong, a snooze ends by itself, and what is over
is forgotten.

State of an alert is what is settled, that is older than the watermark, and the list of its newer rows. Each batch sorts these rows in, so the
order of arrival within the delay doesn't matter. Timers wake a snoozed alert and remove one that has been resolved for ``ttl_seconds``.

Rows older than the watermark are dropped by Spark; rows of one time are taken by ordinal; unknown actions change nothing; a key may be null.
The state store must be RocksDB, which :func:`stores` sets for a session's streams while they start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "source_id long, type string, at timestamp, status string, opened long, reopened long, reason string"
ACTIONS = ("ack", "cleared", "raised", "snooze", "other")  # by name, as rows of one time and ordinal are taken
CODES = {a: i for i, a in enumerate(ACTIONS)}
ROW = np.dtype([("at", "<i8"), ("ordinal", "<i8"), ("action", "i1")])
PACK = 1 << 16  # rows of a value of the list of newer rows
NEW = ("NONE", 0, 0, -1, -1)  # status, opened, reopened, snoozed until, last row (microseconds)


@contextmanager
def stores(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def woken(state: tuple, now: int) -> tuple:
    """A snooze that is over by ``now`` has opened the alert again."""
    status, opened, reopened, until, at = state
    return ("OPEN", opened, reopened + 1, -1, at) if status == "SNOOZED" and 0 <= until <= now else state


def stepped(state: tuple, at: int, action: str, snooze: int) -> tuple:
    """The alert after one more row."""
    status, opened, reopened, until, _ = woken(state, at)
    if action == "raised" and status in ("NONE", "RESOLVED"):
        return "OPEN", opened + 1, reopened, -1, at
    if action == "ack" and status == "OPEN":
        return "ACKNOWLEDGED", opened, reopened, -1, at
    if action == "snooze" and status in ("OPEN", "ACKNOWLEDGED"):
        return "SNOOZED", opened, reopened, at + snooze, at
    if action == "cleared" and status in ("OPEN", "ACKNOWLEDGED"):
        return "RESOLVED", opened, reopened, -1, at
    return status, opened, reopened, until, at


def folded(state: tuple, rows: Iterable[tuple[int, int, str]], snooze: int) -> tuple:
    for at, _, action in sorted(rows):
        state = stepped(state, at, action, snooze)
    return state


def packed(rows: list[tuple[int, int, str]]) -> list[tuple[bytes]]:
    """Rows as few values of the state store, which costs a call or a copy for each; an unknown action changes nothing, whatever its name."""
    whole = np.empty(len(rows), ROW)
    for i, name in enumerate(("at", "ordinal")):
        whole[name] = [r[i] for r in rows]
    whole["action"] = [CODES.get(r[2], len(ACTIONS) - 1) for r in rows]
    return [(whole[a : a + PACK].tobytes(),) for a in range(0, len(rows), PACK)]


def unpacked(values: Iterable[tuple[bytes]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for (value,) in values:
        part = np.frombuffer(value, ROW)
        out += zip(part["at"].tolist(), part["ordinal"].tolist(), map(ACTIONS.__getitem__, part["action"].tolist()), strict=True)
    return out


class TimedAlerts(StatefulProcessor):
    def __init__(self, snooze_seconds: int, ttl_seconds: int):
        self.snooze, self.ttl = snooze_seconds * 1_000_000, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, opened long, reopened long, until long, at long")
        self.newer = handle.getListState("newer", "rows binary")

    def close(self) -> None:
        pass

    def _told(self, rows: list[tuple[int, int, str]], watermark: int) -> tuple:
        """Settles what is older than the watermark, keeps the rest, and gives the alert as it stands."""
        state = tuple(self.settled.get()) if self.settled.exists() else NEW
        old, new = [r for r in rows if r[0] <= watermark], [r for r in rows if r[0] > watermark]
        state = woken(folded(state, old, self.snooze), watermark)
        self.settled.update(state)
        if new:
            self.newer.put(packed(new))
        elif self.newer.exists():
            self.newer.clear()
        return folded(state, new, self.snooze)

    def _timers(self, state: tuple, watermark: int) -> None:
        """One timer: for the end of a snooze, or of what is remembered of a resolved alert."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = state[3] if state[0] == "SNOOZED" else state[4] + self.ttl if state[0] in ("RESOLVED", "NONE") else None
        if due is not None:
            self.handle.registerTimer(max(due, watermark) // 1000 + 1)

    def _row(self, key: tuple, state: tuple, at: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"source_id": [key[0]], "type": [key[1]], "at": [pd.Timestamp(at, unit="us")], "status": [state[0]], "opened": [state[1]], "reopened": [state[2]], "reason": [reason]})

    def _newer(self) -> list[tuple[int, int, str]]:
        return unpacked(self.newer.get()) if self.newer.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._newer()
        for pdf in rows:
            at = pdf["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            held += zip(at.tolist(), pdf["ordinal"].astype(np.int64).tolist(), pdf["action"].tolist(), strict=True)
        state = self._told(held, watermark)
        self._timers(state, watermark)
        yield self._row(key, state, state[4], "rows")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        before = folded(tuple(self.settled.get()) if self.settled.exists() else NEW, self._newer(), self.snooze)
        state = self._told(self._newer(), watermark)
        if state[0] in ("RESOLVED", "NONE") and state[4] + self.ttl <= watermark and not self.newer.exists():
            self.settled.clear()
            return
        self._timers(state, watermark)
        if state[:3] != before[:3]:
            yield self._row(key, state, before[3], "timer")


def timed_alerts(rows: DataFrame, snooze_seconds: int, delay: str, ttl_seconds: int) -> DataFrame:
    """A row for each alert (source_id, type) and batch that changes it, and for each snooze that ends. Input: source_id, type, at, action
    (raised, ack, snooze, cleared), ordinal."""
    keyed = rows.select("source_id", "type", F.col("at").cast("timestamp").alias("at"), "action", F.col("ordinal").cast("long").alias("ordinal")).withWatermark("at", delay)
    return keyed.groupBy("source_id", "type").transformWithStateInPandas(TimedAlerts(snooze_seconds, ttl_seconds), OUTPUT, "update", "eventTime")
