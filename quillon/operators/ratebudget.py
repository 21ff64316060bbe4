"""Request budgets: slots of a first-come queue in closed form, gaps between requests, and a limiter for sources."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GUARD_MS = 50


def slots(requests: DataFrame, interval_ms: int, key: str = "key", at: str = "at_ms", tie: str = "id") -> DataFrame:
    """Adds slot_ms and wait_ms: each request gets max(previous slot + interval, its arrival).

    The recurrence unrolls: with n the place in the queue, slot = max over earlier requests of (arrival - n * interval) + n * interval,
    a running maximum."""
    order = Window.partitionBy(key).orderBy(at, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.row_number().over(order).cast("long")
    rows = requests.withColumn("place", n)
    slot = F.max(F.col(at) - F.col("place") * interval_ms).over(upto) + F.col("place") * interval_ms
    return rows.withColumn("slot_ms", slot).withColumn("wait_ms", F.col("slot_ms") - F.col(at)).drop("place")


def gaps(requests: DataFrame, least_ms: float, key: str = "key", at: str = "at_ms") -> DataFrame:
    """Per key: number, least, median and largest gap between consecutive requests, and gaps under the budget."""
    order = Window.partitionBy(key).orderBy(at)  # in any order requests of one time are 0 apart
    rows = requests.withColumn("gap", F.col(at) - F.lag(at).over(order)).where("gap is not null")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").cast(dict(rows.dtypes)["gap"]).alias("median"), F.max("gap").alias("most"), F.count_if(F.col("gap") < least_ms).alias("under"))


class Limiter:
    """Spaces calls of one process: reserve() returns the seconds to wait; wait() sleeps them. clock and sleep can be replaced in tests."""

    def __init__(self, interval_s: float, guard_s: float = GUARD_MS / 1000, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep = interval_s + guard_s, clock, sleep
        self._last: float | None = None
        self._lock = threading.Lock()

    def reserve(self) -> float:
        with self._lock:
            now = self.clock()
            slot = now if self._last is None else max(self._last + self.interval, now)
            self._last = slot
            return slot - now

    def wait(self) -> float:
        pause = self.reserve()
        if pause > 0:
            self.sleep(pause)
        return pause
