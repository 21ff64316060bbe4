"""Metrics of queries: named counts beside a plan, collected by listeners, and written in the text form of a metrics endpoint."""

from __future__ import annotations

import threading
from collections import defaultdict
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


SAMPLES = "name string, metric string, ts timestamp, value double"


def counted(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """df with `rows` and other measures observed as it runs; no second pass."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()])


class Metrics(StreamingQueryListener):
    """Sums observed numbers over the batches of all streams; spark.streams.addListener(metrics)."""

    def __init__(self):
        self.totals: dict[tuple[str, str], float] = defaultdict(float)
        self.batches = 0
        self.failures: list[str] = []
        self._samples: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        at = datetime.fromisoformat(event.progress.timestamp)
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                for key, value in row.asDict().items():
                    if isinstance(value, int | float):
                        self.totals[name, key] += value
                        self._samples.append((name, key, at, float(self.totals[name, key])))

    def flush(self, spark: SparkSession, path: str) -> int:
        """Adds the samples since the last flush to a table (name, metric, ts, value): counters as they stood after each batch, which
        operators.metrics reads as it reads any other. How many."""
        with self._lock:
            rows, self._samples = self._samples, []
        if rows:
            spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(path)
        return len(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures.append(event.exception)

    def text(self, prefix: str = "quillon") -> str:
        """Counters, one a line."""
        lines = [f'{prefix}_{key}_total{{name="{name}"}} {value:g}' for (name, key), value in sorted(self.totals.items())]
        return "\n".join([*lines, f"{prefix}_batches_total {self.batches}"]) + "\n"


def snapshot(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias(name))
        out = row if out is None else out.crossJoin(F.broadcast(row))  # single rows
    return out
