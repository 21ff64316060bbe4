"""A stored approximate index: a navigable small-world graph over the vectors of each shard, searched with a beam under filters.

Rows are dealt to shards by a hash of their keys, at most about `SHARD_ROWS` each. In a shard equal vectors are one node; nodes are
taken in a random order, and each links to its nearest nodes among the earlier ones and back, so early nodes carry the long
links and late ones the short ones. A shard is one row of the index table: keys, attributes to filter by, vectors and links. The table
is written once and read by all searches.

A search walks all queries of a block through a shard side by side: of each query's beam (its best nodes so far) the best one not yet
opened is opened, its neighbours are scored, and the walk ends when every node of the beam is open. Filters are
expressions over the attributes, evaluated by Spark beside the shard; the walk passes through all nodes and keeps allowed rows
only. Where few nodes of a shard are allowed, these are scored directly, and so are nodes that no walk can reach.

Query sets are read in blocks of at most `QUERY_BLOCK` vectors, each broadcast and run over all shards before the next one is read.

Defined cases: rows without a vector are not indexed; zero vectors have score 0; vectors of another length than a shard's first one
are not indexed; equal scores go by the keys; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.vectors import DIGITS, QUERY_BLOCK
from quillon.shared import cut

LINKS, BEAM, SHARD_ROWS, ENTRIES = 16, 96, 20_000, 16
#: Walks side by side, and nodes of a graph that are linked together.
WALKS, LINKED = 512, 256
#: Rows that a shard gives beyond the n asked for: walks score in single precision, results are ranked in double.
SPARE = 8
#: Shards with so many allowed nodes a place of the beam, or fewer, are scored directly.
FEW_A_PLACE = 40
#: Of the stored form: a change of it is another table.
VERSION = 1


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def link(vectors: np.ndarray, m: int = LINKS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries): each node's neighbours, filled up with the node itself, and the nodes where walks begin."""
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n)
    v, forward, near = vectors[order], np.full((n, m), -1, np.int64), np.zeros((n, m), np.float32)
    for a in range(0, n, LINKED):
        b = min(n, a + LINKED)
        s = v[a:b] @ v[:b].T
        s[np.arange(b) >= np.arange(a, b)[:, None]] = -np.inf  # only earlier nodes
        k = min(m, b)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        score = np.take_along_axis(s, best, 1)
        forward[a:b, :k] = np.where(np.isfinite(score), best, -1)
        near[a:b, :k] = score
    at, slot = np.nonzero(forward >= 0)
    to, score = forward[at, slot], near[at, slot]
    by = np.lexsort((-score, to))
    to, at = to[by], at[by]
    place = np.arange(len(to)) - np.searchsorted(to, to)  # among the links back to a node
    kept = place < 2 * m
    links = np.repeat(np.arange(n)[:, None], 3 * m, 1)
    links[:, :m] = np.where(forward >= 0, forward, links[:, :m])
    links[to[kept], m + place[kept]] = at[kept]
    original = np.empty((n, 3 * m), np.int32)
    original[order] = order[links]
    return original, order[:ENTRIES].astype(np.int32)


def unreached(links: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nodes that no walk from the entries can reach."""
    seen = np.zeros(len(links), bool)
    front = np.unique(entries)
    while len(front):
        seen[front] = True
        front = np.unique(links[front])
        front = front[~seen[front]]
    return np.flatnonzero(~seen)


class Shard:
    """Distinct vectors as nodes, the rows of each node, and the graph."""

    def __init__(self, raw: np.ndarray, links: np.ndarray, entries: np.ndarray, lone: np.ndarray, node: np.ndarray):
        self.raw, self.links, self.entries, self.lone, self.node = raw, links, entries, lone, node
        self.vectors = unit(raw.astype(np.float64)).astype(np.float32)

    @classmethod
    def build(cls, rows: np.ndarray, m: int = LINKS) -> Shard:
        raw, node = np.unique(rows.astype(np.float32), axis=0, return_inverse=True)
        links, entries = link(unit(raw.astype(np.float64)).astype(np.float32), m)
        return cls(raw, links, entries, unreached(links, entries), node.ravel().astype(np.int32))

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.raw.astype("<f4"), self.links.astype("<i4"), self.entries.astype("<i4"), self.lone.astype("<i4"), self.node.astype("<i4"))]

    @classmethod
    def open(cls, parts: list[bytes], width: int) -> Shard:
        v, links, entries, lone, node = (np.frombuffer(p, "<f4" if k == 0 else "<i4") for k, p in enumerate(parts))
        v = v.reshape(-1, width)
        return cls(v, links.reshape(len(v), -1), entries, lone, node)

    def walk(self, queries: np.ndarray, n: int, beam: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) of each query's best n allowed nodes met, -1 where there are fewer."""
        count, total = len(queries), len(self.vectors)
        seen = np.zeros((count, total), bool)
        start = np.unique(np.concatenate([self.entries, self.lone])).astype(np.int64)
        seen[:, start] = True
        scores = queries @ self.vectors[start].T
        ids = np.broadcast_to(start, scores.shape)
        none = lambda size: (np.full((count, size), -1, np.int64), np.full((count, size), -np.inf, np.float32))
        found = _best(*none(n), ids, np.where(allowed[start], scores, -np.inf), n)
        node, score = _best(*none(beam), ids, scores, beam)
        closed = np.isfinite(score)
        live = np.arange(count)
        while len(live):
            waiting = np.where(closed[live], score[live], -np.inf)
            at = waiting.argmax(1)
            more = np.isfinite(waiting[np.arange(len(live)), at])
            live, at = live[more], at[more]
            if not len(live):
                break
            closed[live, at] = False
            next_to = self.links[node[live, at]].astype(np.int64)
            new = ~seen[live[:, None], next_to]
            seen[live[:, None], next_to] = True
            near = np.where(new, np.einsum("qkd,qd->qk", self.vectors[next_to], queries[live]), -np.inf)
            found[0][live], found[1][live] = _best(found[0][live], found[1][live], next_to, np.where(allowed[next_to], near, -np.inf), n)
            both = np.concatenate([score[live], near], 1)
            keep = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
            take = lambda x: np.take_along_axis(x, keep, 1)
            node[live], score[live], closed[live] = take(np.concatenate([node[live], next_to], 1)), take(both), take(np.concatenate([closed[live], new], 1))
        return found

    def search(self, queries: np.ndarray, n: int, beam: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of each query's best n allowed rows; rows of a node go in their order."""
        open_nodes = np.zeros(len(self.vectors), bool)
        open_nodes[self.node[allowed]] = True
        some = np.flatnonzero(open_nodes)
        if not len(some) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(some) <= FEW_A_PLACE * beam:
            scores = queries @ self.vectors[some].T
            node, score = _best(np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.float32), np.broadcast_to(some, scores.shape), scores, n)
        else:
            node, score = self.walk(queries, n, beam * len(self.vectors) // len(some), open_nodes)  # as many allowed places as without a filter
        rows = np.flatnonzero(allowed)
        by = np.argsort(self.node[rows], kind="stable")
        rows, of = rows[by], self.node[rows][by]
        first, last = np.searchsorted(of, node, "left"), np.searchsorted(of, node, "right")
        held = np.where(np.isfinite(score), np.minimum(last - first, n), 0)
        query = np.repeat(np.arange(len(queries)), held.sum(1))
        flat = held.ravel()
        begin = np.repeat(first.ravel(), flat) + np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
        return query, rows[begin]


def _best(node: np.ndarray, score: np.ndarray, more: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The best n of two lists of nodes a query."""
    node, score = np.concatenate([node, more], 1), np.concatenate([score, scores], 1)
    if score.shape[1] > n:
        keep = np.argpartition(-score, n - 1, axis=1)[:, :n]
        node, score = np.take_along_axis(node, keep, 1), np.take_along_axis(score, keep, 1)
    return node, score


PARTS = ("vectors", "links", "entries", "lone", "nodes")


def build(base: DataFrame, keys: Sequence[str] = ("paper_id", "idx"), attributes: Sequence[str] = (), shard_rows: int = SHARD_ROWS, m: int = LINKS) -> DataFrame:
    """The index table of base (keys.. long, embedding, attributes..): a row a shard, to be written and opened as `GraphIndex`."""
    base = base.where(F.col("embedding").isNotNull())
    shards = max(1, -(-base.count() // shard_rows))
    named = F.struct(*[F.col(k).cast("long").alias(k) for k in keys]).alias("key")
    rows = base.select(named, F.struct(*attributes, F.lit(True).alias("indexed")).alias("attribute"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    kinds = dict(rows.dtypes)

    def make(table: pa.Table) -> pa.Table:
        order = table.column("key").combine_chunks()
        at = np.lexsort([np.asarray(order.field(k).fill_null(0)) for k in reversed(keys)])
        table = table.take(pa.array(at)).combine_chunks()
        lists = table.column("embedding").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        fit = sizes == sizes[0]
        table = table.filter(pa.array(fit))
        lists = table.column("embedding").combine_chunks()
        shard = Shard.build(np.asarray(lists.flatten().fill_null(0), np.float64).reshape(len(lists), int(sizes[0])), m)

        def whole(c: str) -> pa.Array:
            own = table.column(c).combine_chunks()
            kind = pa.struct([pa.field(f.name, f.type) for f in own.type])  # every field may be null, as the schema says
            return pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), own).cast(pa.list_(kind))

        columns = [table.column("shard").slice(0, 1), pa.array([int(sizes[0])], pa.int32()), whole("key"), whole("attribute"), *[pa.array([p], pa.binary()) for p in shard.pack()]]
        return pa.table(columns, names=["shard", "width", "keys", "attributes", *PARTS])

    schema = f"shard int, width int, keys array<{kinds['key']}>, attributes array<{kinds['attribute']}>, " + ", ".join(f"{p} binary" for p in PARTS)
    return rows.groupBy("shard").applyInArrow(make, schema)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of at most `size` queries at a time."""
    ids: list[int] = []
    vectors: list = []
    for r in queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector").toLocalIterator():
        ids.append(r.query_id)
        vectors.append(r.vector)
        if len(ids) == size:
            yield np.array(ids, np.int64), unit(np.array(vectors, np.float64))
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), unit(np.array(vectors, np.float64))


class GraphIndex:
    """A stored index table, searched. `keys` are those it was built with."""

    def __init__(self, table: DataFrame, keys: Sequence[str] = ("paper_id", "idx")):
        self.table, self.keys = table, tuple(keys)

    def search(self, queries: DataFrame, n: int, where: Callable[[Column], Column] | None = None, beam: int = BEAM, not_self: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, *keys, score): each query's n nearest rows among those that `where` (an expression over the attributes' struct)
        allows, by rounded cosine and then keys. not_self: the key that must differ from query_id."""
        keys, width = self.keys, max(beam, n)
        schema = ", ".join(["query_id long", *[f"{k} long" for k in keys], "score double"])
        allowed = F.transform("attributes", lambda a: F.coalesce(where(a), F.lit(False)) if where else F.lit(True))
        shards = self.table.select("keys", "width", allowed.alias("allowed"), *PARTS)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
        context = self.table.sparkSession.sparkContext

        def run(ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
            shared = context.broadcast((ids, vectors))

            def task(batches):
                ids, vectors = shared.value
                for batch in batches:
                    for k in range(batch.num_rows):
                        size = batch.column("width")[k].as_py()
                        if vectors.shape[1] != size:
                            continue
                        shard = Shard.open([batch.column(p)[k].as_py() for p in PARTS], size)
                        may = np.asarray(batch.column("allowed")[k].values)
                        held = batch.column("keys")[k].values
                        unit_rows = unit(shard.raw.astype(np.float64))
                        for a in range(0, len(ids), WALKS):  # memory is that of so many walks
                            own = vectors[a : a + WALKS]
                            query, row = shard.search(own.astype(np.float32), n + SPARE, width, may)
                            values = [np.asarray(held.field(c))[row] for c in keys]
                            score = np.round(np.einsum("rd,rd->r", unit_rows[shard.node[row]], own[query]), DIGITS)
                            keep = values[keys.index(not_self)] != ids[a + query] if not_self else np.ones(len(row), bool)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[a + query][keep]), *[pa.array(v[keep]) for v in values], pa.array(score[keep])], ["query_id", *keys, "score"])

            found = shards.mapInArrow(task, schema)
            return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).drop("place")

        parts, blocks = [], query_blocks(queries, block)
        held = next(blocks, None)
        while held is not None:
            found, held = run(*held), next(blocks, None)
            parts.append(cut(found) if held or parts else found)  # of several blocks each is run before the next but one is read
        if not parts:
            return self.table.sparkSession.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)
