"""Stateful streams: one event per paper version, dwell times of pages, cached answers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.cache import DISTANCE, TTL_SECONDS
from quillon.operators.trail import DWELL_SECONDS
from quillon.operators.vectors import DIGITS
from quillon.streaming.retry import use_timers


def first_versions(papers: DataFrame, keys: tuple[str, ...] = ("paper_id", "version"), late: str | None = None) -> DataFrame:
    """Each key once. With `late` ("7 days") the state keeps keys for that event time only (column ts); else it keeps them all."""
    if late:
        return papers.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return papers.dropDuplicates(list(keys))


def earliest(events: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The batch form of first_versions, and its result over a whole log: of each key the event of the least `order`."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(*keys, "first.*")


def _dwell(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds the time from each visible event to the next; tells a page once, when it has been seen for long enough."""
    seconds, since, told = state.get if state.exists else (0.0, None, False)
    rows = pd.concat(list(frames)).sort_values("ts")
    for at, visible in zip(rows["ts"], rows["visible"]):
        now = at.timestamp()
        if since is not None:
            seconds += max(0.0, now - since)
        since = now if visible else None
    out = pd.DataFrame({"user_id": [], "paper_id": [], "seconds": []}).astype({"user_id": "int64", "paper_id": "int64", "seconds": "float64"})
    if seconds >= DWELL_SECONDS and not told:
        told = True
        out = pd.DataFrame({"user_id": [key[0]], "paper_id": [key[1]], "seconds": [seconds]})
    state.update((seconds, since, told))
    yield out


def dwell_stream(events: DataFrame) -> DataFrame:
    """(user_id, paper_id, seconds) as soon as a page has been visible for DWELL_SECONDS, from a stream of (user_id, paper_id, ts, visible)."""
    return events.groupBy("user_id", "paper_id").applyInPandasWithState(_dwell, "user_id long, paper_id long, seconds double", "seconds double, since double, told boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in event-time windows; NTZ times are read as UTC."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))


# -- state that ends ---------------------------------------------------------------------------------

IDLE_MS = 30 * 60 * 1000


class _Dwell(StatefulProcessor):
    """Visible seconds of one (user, page). The state ends when event time is `idle` past its last event."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("dwell", "seconds double, since double, told boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds, since, told, last = tuple(self.state.get()) if self.state.exists() else (0.0, None, False, 0)
        frame, out = pd.concat(list(rows)).sort_values("ts"), []
        for at, visible in zip(frame["ts"], frame["visible"]):
            now = at.timestamp()
            if last and 1000 * now - last > self.idle:  # before the timer of the pause could run
                seconds, since, told = 0.0, None, False
            if since is not None:
                seconds += max(0.0, now - since)
            if seconds >= DWELL_SECONDS and not told:
                told = True
                out.append((*key, seconds))
            since, last = (now if visible else None), max(last, int(1000 * now))
        self.state.update((seconds, since, told, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame(out, columns=["user_id", "paper_id", "seconds"]).astype({"user_id": "int64", "paper_id": "int64", "seconds": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "paper_id": pd.Series([], dtype="int64"), "seconds": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def dwell_sessions(events: DataFrame, late: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """dwell_stream with state that ends: a page that had no event for `idle` of event time is forgotten, and counts anew after that."""
    use_timers(events.sparkSession)
    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id", "paper_id").transformWithStateInPandas(_Dwell(idle_ms), "user_id long, paper_id long, seconds double", "Append", "EventTime")


class _Cache(StatefulProcessor):
    """Stored answers of one scope, each for its time to live."""

    def __init__(self, ttl_ms: int, distance: float):
        self.ttl, self.distance = ttl_ms, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("stored", "response string", "vector array<double>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        held, out = None, []
        for query, vector, response in zip(frame["query_id"], frame["vector"], frame["response"]):
            if held is None:
                held = {k[0]: np.array(v[0], float) for k, v in self.stored.iterator()}
            v = np.array(vector, float)
            if response is not None:
                self.stored.updateValue((response,), ([float(x) for x in v],))
                held[response] = v
                continue
            size = {r: np.linalg.norm(x) * np.linalg.norm(v) for r, x in held.items()}
            far = {r: round(1 - float(x @ v) / size[r], DIGITS) for r, x in held.items() if size[r] > 0}
            best = min(far, key=lambda r: (far[r], r), default=None)
            hit = best is not None and far[best] <= self.distance
            out.append((int(query), best if hit else None, far[best] if hit else None))
        yield pd.DataFrame(out, columns=["query_id", "response", "distance"]).astype({"query_id": "int64", "distance": "float64"})

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl_seconds: float = TTL_SECONDS, distance: float = DISTANCE) -> DataFrame:
    """(query_id, response, distance) for each question of a stream (scope, query_id, vector, response, at): rows with a response are stored
    for their time to live, rows without one are questions and get the nearest live answer of their scope, or nulls."""
    use_timers(requests.sparkSession)
    return requests.groupBy("scope").transformWithStateInPandas(_Cache(max(1, int(1000 * ttl_seconds)), distance), "query_id long, response string, distance double", "Append", "ProcessingTime")
