"""Connected components over edge tables, and streaming of sorted groups through Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import runs
from quillon.shared import cut


def stream_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by `key`, over the borders of batches; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(key))
        first = runs(values)
        if held and np.asarray(held[-1].column(key))[-1] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(first[:-1], first[1:]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(first[-1]))
    if held:
        yield pa.Table.from_batches(held)


def spread(rows: DataFrame, key: str, size: str, node: str, limit: int) -> DataFrame:
    """Groups of over `limit` rows as groups of at most about `limit`: a group's nodes are dealt to blocks of half a limit, and
    each two blocks meet as one group (key becomes a hash of it and the two blocks). So any two nodes of a group still meet,
    in bounded memory, and the work on a large group is dealt to many tasks. Smaller groups stay as they are."""
    n = F.when(F.col(size) > limit, F.ceil(F.col(size) / max(1, limit // 2))).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("own_block", F.pmod(F.xxhash64(node), n).cast("int"))
    rows = rows.withColumn("other_block", F.explode(F.sequence(F.lit(0), n - 1)))
    pair = F.xxhash64(key, F.least("own_block", "other_block"), F.greatest("own_block", "other_block"))
    return rows.withColumn(key, F.when(F.col(size) > limit, pair).otherwise(F.col(key))).drop("own_block", "other_block")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b): root is the least node that it is connected with.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): a logarithmic number of rounds in practice, edges
    never grow, and a node with many neighbours costs its edges only. Each round is cut, so lineage stays flat."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
