"""Vector operators: cosine scores, filtered top-N, batched nearest neighbours, and an optional inverted-file index.

Scoring runs over Arrow batches in numpy: `TILE` vectors are one matrix, multiplied with as many queries at a time, and only each query's
best `n` of all batches leave the task. So the shuffle carries at most n rows a query and task, and a task holds one tile of
scores and those n rows a query, however large the corpus and the query set are.
Query sets are read to the driver in blocks of at most `QUERY_BLOCK` vectors and broadcast; a larger set takes more passes, over queries,
vectors and matches that are each computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.best import Best
from quillon.shared import cut

QUERY_BLOCK, TILE = 4096, 1024
DIGITS = 6  # scores are rounded before they are compared, so ties fall alike everywhere


def l2_normalize(v: Column) -> Column:
    """A unit vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, without Python."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    n = len(column)
    return np.asarray(flat, np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def top_matches(queries: DataFrame, base: DataFrame, n: int, keys: Sequence[str] = ("paper_id", "idx"), not_self: str | None = None, probe: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Each query's n nearest rows of base: (query_id, *keys, score), by rounded cosine and then keys.

    queries: (query_id long, vector). base: (*keys longs, embedding). not_self: the key that must differ from query_id.
    probe: which cells (columns) each query (a row of unit vectors) reads, as booleans; base then has a column cell."""
    base = base.where(F.col("embedding").isNotNull()).select(*[F.col(k).cast("long").alias(k) for k in keys], "embedding", *(["cell"] if probe else []))
    queries = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    if blocks > 1:  # else each pass would compute both anew
        queries, base = cut(queries), cut(base)
    schema = ", ".join(["query_id long", "score double", *[f"{k} long" for k in keys]])
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.collect()
        ids = np.array([r.query_id for r in rows], np.int64)
        matrix = _unit(np.array([r.vector for r in rows], np.float64)) if rows else np.zeros((0, 1))
        shared = base.sparkSession.sparkContext.broadcast((ids, matrix, probe(matrix) if probe else None))

        def task(batches, shared=shared):
            q, m, probed = shared.value
            best = Best(len(q), n, len(keys))
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                cell = np.asarray(batch.column("cell")) if probed is not None else np.zeros(batch.num_rows, np.int32)
                for c in np.unique(cell):  # a cell's rows meet the queries that read the cell
                    asked = np.flatnonzero(probed[:, c]) if probed is not None else np.arange(len(q))
                    rows = np.flatnonzero(cell == c)
                    for at in range(0, len(rows) if len(asked) else 0, TILE):
                        meet(best, q, m, asked, batch.take(pa.array(rows[at : at + TILE])))
            yield from best.batches(q, ["query_id", "score", *keys])

        def meet(best, q, m, asked, batch):
            values = [np.asarray(batch.column(k)) for k in keys]
            unit = _unit(_matrix(batch.column("embedding")))
            for a in range(0, len(asked), TILE):
                own = asked[a : a + TILE]
                scores = np.round(m[own] @ unit.T, DIGITS)
                if not_self:
                    scores[q[own][:, None] == values[keys.index(not_self)]] = -np.inf
                best.add_matrix(own, scores, *values)

        part = base.mapInArrow(task, schema)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("query_id", *keys, "score")
    return cut(out) if blocks > 1 else out  # else each use of the matches would make all passes again


def best_per_paper(matches: DataFrame) -> DataFrame:
    """The best passage of each paper for each query."""
    best = Window.partitionBy("query_id", "paper_id").orderBy(F.desc("score"), "idx")
    return matches.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def neighbors(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, paper_id, sim, rank): the k papers whose first passage is nearest to each query paper's, itself excluded."""
    first = chunks.where("idx = 0").select("paper_id", "embedding")
    asked = queries.join(first, queries.query_id == first.paper_id).select("query_id", F.col("embedding").alias("vector"))
    found = top_matches(asked, first, k, keys=("paper_id",), not_self="paper_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    return found.select("query_id", "paper_id", F.col("score").alias("sim"), F.row_number().over(order).alias("rank"))


class CellIndex:
    """An inverted-file index: every row is put in the cell of its nearest centroid; a search reads the cells nearest to the query.

    Centroids are fitted by spherical k-means on at most `sample` rows (the least by a hash of their keys); all rows are indexed.
    `indexed` carries the cell as a column, to be written partitioned by it, so a search prunes files."""

    def __init__(self, base: DataFrame, keys: Sequence[str] = ("paper_id", "idx"), cells: int = 16, sample: int = 20_000, rounds: int = 10, seed: int = 1):
        self.keys = tuple(keys)
        rows = base.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(*keys)).limit(sample).select("embedding").collect()
        m = _unit(np.array([r.embedding for r in rows], np.float64)) if rows else np.zeros((1, 1))
        r = np.random.default_rng(seed)
        self.centroids = m[r.choice(len(m), min(cells, len(m)), replace=False)]
        for _ in range(rounds):
            cell = (m @ self.centroids.T).argmax(1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, cell, m)
            filled = np.bincount(cell, minlength=len(sums)) > 0
            self.centroids[filled] = _unit(sums[filled])
        shared = base.sparkSession.sparkContext.broadcast(self.centroids)
        names = [*self.keys, "embedding"]
        base = base.select(*[F.col(k).cast("long").alias(k) for k in self.keys], F.col("embedding").cast("array<float>").alias("embedding"))

        def task(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = (_matrix(batch.column("embedding")) @ shared.value.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cell)], [*names, "cell"])

        self.indexed = base.where(F.col("embedding").isNotNull()).mapInArrow(task, ", ".join([*[f"{k} long" for k in self.keys], "embedding array<float>", "cell int"]))

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Whether each query (a row) reads each cell: its `probes` nearest."""
        out = np.zeros((len(queries), len(self.centroids)), bool)
        if len(queries) and queries.shape[1] == self.centroids.shape[1]:  # an index of an empty table has no dimension
            np.put_along_axis(out, np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :probes], True, 1)
        return out

    def search(self, queries: DataFrame | Sequence[float], n: int, probes: int = 4, query_id: int = 0) -> DataFrame:
        """Each query's n nearest rows in its nearest cells, as top_matches. queries: (query_id, vector), or one vector, named query_id."""
        if not isinstance(queries, DataFrame):
            queries = self.indexed.sparkSession.createDataFrame([(query_id, [float(x) for x in queries])], "query_id long, vector array<double>")
        return top_matches(queries, self.indexed, n, keys=self.keys, probe=lambda m: self.probed(m, probes))
