"""The stored graph index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graphindex as G
from quillon.operators import vectors as V


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 24)).astype(np.float32)
    v[2000:2400] = v[17]  # equal vectors
    v[2500] = 0
    return v


@pytest.fixture(scope="module")
def base(spark, rows):
    data = [(k // 4, k % 4, [float(x) for x in v], ["a", "b", "c"][k % 3]) for k, v in enumerate(rows)]
    data += [(9000, 0, None, "a"), (9001, 0, [1.0, 2.0], "a")]
    return spark.createDataFrame(data, "paper_id long, idx long, embedding array<float>, kind string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, base, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    G.build(base, attributes=("kind",), shard_rows=1100).write.mode("overwrite").parquet(path)
    return G.GraphIndex(spark.read.parquet(path))


@pytest.fixture(scope="module")
def queries(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in rows[k]]) for k in range(0, 3000, 60)] + [(99_999, None)], "query_id long, vector array<double>")


def pairs(df):
    return {(r.query_id, r.paper_id, r.idx) for r in df.collect()}


@pytest.mark.parametrize("kind", [None, "a"])
def test_recall_with_and_without_a_filter(base, index, queries, kind):
    exact = V.top_matches(queries, base.where(F.size("embedding") == 24) if kind is None else base.where((F.col("kind") == kind) & (F.size("embedding") == 24)), 10)
    got = index.search(queries, 10, (lambda a: a["kind"] == kind) if kind else None)
    want, found = pairs(exact), pairs(got)
    assert len(found) == len(want) == 500 and len(found & want) >= 0.9 * len(want)
    score = {(r.query_id, r.paper_id, r.idx): r.score for r in exact.collect()}
    assert all(abs(score[k] - r.score) < 1e-6 for r in got.collect() if (k := (r.query_id, r.paper_id, r.idx)) in score)


def test_blocks_of_queries_give_the_same(index, queries):
    assert pairs(index.search(queries, 10, block=7)) == pairs(index.search(queries, 10))


def test_self_is_left_out(spark, base, queries):
    own = base.where("idx = 0").drop("idx")
    index = G.GraphIndex(G.build(own, keys=("paper_id",)), keys=("paper_id",))
    asked = own.where("paper_id % 40 = 0 and size(embedding) = 24").select(F.col("paper_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.search(asked, 5, not_self="paper_id").collect()
    assert all(r.paper_id != r.query_id for r in found) and len(found) == 5 * asked.count()


def test_walks_alone(rows):
    """The beam without direct scoring, on the whole table."""
    shard = G.Shard.build(rows)
    allowed = np.arange(len(shard.vectors)) % 2 == 0
    q = shard.vectors[::50]
    node, _ = shard.walk(q, 10, 200, allowed)
    exact = q @ shard.vectors.T
    exact[:, ~allowed] = -2
    best = np.argsort(-exact, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(node.tolist(), best.tolist())]) > 0.9
    assert allowed[node].all()


def test_every_node_is_reached_or_lone():
    links = np.array([[1, 1], [0, 0], [3, 3], [2, 2], [0, 4]])
    assert G.unreached(links, np.array([0])).tolist() == [2, 3, 4]
    v = np.random.default_rng(1).normal(size=(700, 8)).astype(np.float32)
    links, entries = G.link(v)
    assert (links >= 0).all() and links.shape == (700, 48) and len(G.unreached(links, entries)) < 70


def test_opened_as_packed(rows):
    a = G.Shard.build(rows[:300])
    b = G.Shard.open(a.pack(), rows.shape[1])
    for x in ("raw", "links", "entries", "lone", "node", "vectors"):
        assert (getattr(a, x) == getattr(b, x)).all()


def test_empty(spark, base, queries):
    index = G.GraphIndex(G.build(base.limit(0), attributes=("kind",)))
    assert index.search(queries, 10).count() == 0
    full = G.GraphIndex(G.build(base.limit(3)))
    assert full.search(queries.limit(0), 10).count() == 0
