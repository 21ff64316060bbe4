"""A stateful queue of messages that wait for another attempt."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a retry log: the message, the attempts so far and their last error, and when it is due (milliseconds).
WAITING = "key string, value string, attempts int, error string, due long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """State with timers and expiry needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _out(key: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, value, attempts, error) for value, attempts, error, _ in rows], columns=["key", "value", "attempts", "error"])


class Delay(StatefulProcessor):
    """Holds each message until it is due. The state of a key is the messages that wait, and ends with the last of them; a row that a
    repeated batch brings again is held once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "value string, attempts int, error string, due long")

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held, out = timerValues.getCurrentProcessingTimeInMs(), self._held(), []
        known = {x[:2] for x in held}
        for value, attempts, error, due in (r for f in rows for r in zip(f["value"], f["attempts"], f["error"], f["due"])):
            row = (value, int(attempts), error, int(due))
            if row[:2] in known:
                continue
            known.add(row[:2])
            if row[3] <= now:
                out.append(row)
            else:
                held.append(row)
                self.handle.registerTimer(row[3])
        if held:
            self.waiting.put(held)
        yield _out(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self._held()
        later = [x for x in held if x[3] > now]
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        yield _out(key[0], [x for x in held if x[3] <= now])

    def close(self) -> None:
        pass


def due(waiting: DataFrame) -> DataFrame:
    """(key, value, attempts, error) of a stream of WAITING rows, each when its time has come."""
    use_timers(waiting.sparkSession)
    return waiting.groupBy("key").transformWithStateInPandas(Delay(), "key string, value string, attempts int, error string", "Append", "ProcessingTime")
