"""Keyed state on the event bus: open incidents, and a circuit breaker whose time-out is an event-time timer.

State lives in the state store of the query, by key, so a query that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.streaming.bus import LATE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state needs, for queries that start inside."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


INTAKE, RESOLVED = "incident_intake", "incident_resolved"
INCIDENT = "repo_id string, status string, snapshot string, since timestamp"


class Incidents(StatefulProcessor):
    """Of each repository the latest intake or resolution, whatever the order in which events come; every change is a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, event_type string, snapshot string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        now = before
        for frame in rows:
            top = frame.sort_values(["timestamp", "event_type", "data"]).iloc[-1]
            found = (top["timestamp"].to_pydatetime(), top["event_type"], top["data"] or "")
            now = found if now is None or found > tuple(now) else now
        if now != before:
            self.last.update(now)
            status = "open" if now[1] == INTAKE else "resolved"
            yield pd.DataFrame({"repo_id": [key[0]], "status": [status], "snapshot": [now[2]], "since": [pd.Timestamp(now[0])]})

    def close(self) -> None:
        pass


def incidents(stream: DataFrame) -> DataFrame:
    """The incident of each repository whenever it changes: its status, the snapshot of the event, and since when."""
    flat = stream.where(F.col("event_type").isin(INTAKE, RESOLVED)).select("repo_id", "event_type", "timestamp", F.to_json("data").alias("data"))
    return flat.groupBy("repo_id").transformWithStateInPandas(Incidents(), INCIDENT, "Update", "None")


def open_incidents(changes: DataFrame) -> DataFrame:
    """The incidents that are open after all changes."""
    last = changes.groupBy("repo_id").agg(F.max(F.struct("since", "status", "snapshot")).alias("e"))
    return last.where("e.status = 'open'").select("repo_id", "e.snapshot", "e.since")


BREAKER = "key string, id long, at timestamp, state string, refused boolean"


class Breaker(StatefulProcessor):
    """Calls wait in the state until the watermark has passed them and are then judged in order of time and id.

    One timer for each key stands at the next thing to do: the first waiting call, or the end of the pause of an open breaker.
    """

    def __init__(self, most: int, reset_s: int):
        self.most, self.reset_s = most, reset_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, failed boolean")
        self.now = handle.getValueState("now", "state string, failures int, last long")

    def _wake(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def _next(self, calls: list, state: tuple) -> None:
        times = [calls[0][0] * 1000] if calls else []
        if state[0] == "OPEN":
            times.append((state[2] + self.reset_s + 1) * 1000)
        if times:
            self._wake(min(times))

    def _state(self) -> tuple:
        return tuple(self.now.get()) if self.now.exists() else ("CLOSED", 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        for frame in rows:
            frame = frame[frame["id"].notna()]
            calls += zip(frame["second"].tolist(), frame["id"].astype("int64").tolist(), frame["failed"].astype(bool).tolist(), strict=True)
        if not calls:
            return iter(())
        calls.sort()
        self.waiting.put(calls)
        self._next(calls, self._state())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        calls = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due, rest = [c for c in calls if c[0] <= passed], [c for c in calls if c[0] > passed]
        state, failures, last = self._state()
        out = []
        for second, id_, failed in [*due, (passed + 1, None, None)]:
            if state == "OPEN" and second - last > self.reset_s:
                state = "HALF_OPEN"
                out.append((None, last + self.reset_s + 1, state, False))
            if id_ is None:
                break
            if state == "OPEN":
                out.append((id_, second, "OPEN", True))
                continue
            if failed:
                failures, last = failures + 1, second
                state = "OPEN" if failures >= self.most else state
            elif state == "HALF_OPEN":
                state, failures = "CLOSED", 0
            out.append((id_, second, state, False))
        self.now.update((state, failures, last))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._next(rest, (state, failures, last))
        if out:
            ids = pd.array([o[0] for o in out], dtype="Int64")
            yield pd.DataFrame({"key": key[0], "id": ids, "at": pd.to_datetime([o[1] for o in out], unit="s", utc=True), "state": [o[2] for o in out], "refused": [o[3] for o in out]})

    def close(self) -> None:
        pass


def breaker(calls: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", failed: str = "failed", most: int = 5, reset_s: int = 60, late: str = LATE) -> DataFrame:
    """A stream of calls to the breaker's state after each, and a row without id where the pause of an open one ends.

    As ``timewin.breaker_states`` on the same calls, for those that the watermark has passed; calls later than ``late`` are left out. A
    null key is the empty one; a call without an id only moves the watermark; a null outcome is no failure.
    """
    rows = calls.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    timed = rows.withColumn("second", F.unix_timestamp("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Breaker(most, reset_s), BREAKER, "Append", "EventTime")
