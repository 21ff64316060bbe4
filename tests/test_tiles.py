"""Memory and shuffles of vector search that do not grow with the query set or the table, and ids beyond five digits."""

import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.operators import graphindex as G
from quillon.operators import vectors as V
from quillon.plans import cases
from quillon.plans import queries as catalogue

DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata/sf0.001")


def test_a_task_sends_its_best_rows_once(spark):
    """Not the best of each batch: 40 batches of a task send 5 rows a query, as one does."""
    r = np.random.default_rng(3)
    data = [(k, 0, [float(x) for x in v]) for k, v in enumerate(np.round(r.normal(size=(2000, 3))))]  # many equal scores
    base = spark.createDataFrame(data, "paper_id long, idx long, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(r.normal(size=(30, 3)))], "query_id long, vector array<double>")
    one = sorted(map(tuple, V.top_matches(queries, base, 5).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = V.top_matches(queries, base, 5)
        sent = found._jdf.queryExecution().executedPlan().collectLeaves() and found.collect()
        metrics = [s for s in _rows_of(found, "MapInArrow")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, sent)) == one and len(one) == 150
    assert metrics == [150]


def test_more_passes_compute_queries_vectors_and_matches_once(spark, monkeypatch):
    """With 8 passes the query set was computed 9 times, the vectors 8 times for each use of the matches."""
    met = {name: spark.sparkContext.accumulator(0) for name in ("queries", "base")}

    def counted(df, name):
        def task(batches):
            for batch in batches:
                met[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(task, df.schema)

    r = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in np.round(r.normal(size=(300, 4)), 1)]
    base = spark.createDataFrame([(k, 0, v) for k, v in enumerate(vectors)], "paper_id long, idx long, embedding array<float>")
    queries = spark.createDataFrame([(k, v) for k, v in enumerate(vectors[:50])], "query_id long, vector array<float>")
    want = sorted(map(tuple, V.top_matches(queries, base, 5).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    found = V.top_matches(counted(queries, "queries"), counted(base, "base"), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.collect())) == want and len(want) == 250
    assert met["queries"].value <= 100 and met["base"].value == 300


def _rows_of(df, node):
    """Output rows of the nodes of that name in df's executed plan."""
    def walk(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if "QueryStage" in plan.nodeName():
            plan = plan.plan()
        if plan.nodeName().startswith(node):
            yield plan.metrics().apply("pythonNumRowsReceived").value()
        children = plan.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    return walk(df._jdf.queryExecution().executedPlan())


def _made(folder, n):
    """n vectors, every third one repeated, in one file of one batch, a paper for each four of them, and the customers."""
    os.makedirs(folder)
    r = np.random.default_rng(8)
    rows = np.repeat(r.normal(size=(-(-n // 3), 8)).astype(np.float32), 3, axis=0)[:n]
    rows[1::3] = r.normal(size=rows[1::3].shape)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(rows)), "label": pa.array(np.zeros(n, np.int32))}), f"{folder}/embeddings.parquet")
    ids = np.arange(n // 4)
    texts = [f"paper {k} of many" for k in ids]
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en" if k % 3 else "fr" for k in ids], "source": ["web"] * len(ids), "n_chars": [len(x) for x in texts]}), f"{folder}/documents.parquet")
    pq.write_table(pq.read_table(f"{DATA}/customer.parquet"), f"{folder}/customer.parquet")
    return str(folder)


def _plain(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", ["search_hits", "dense_fallback", "category_precision"])
def test_a_task_of_the_searches_holds_one_tile_of_scores(spark, monkeypatch, tmp_path, name):
    """With four times the vectors, and so four times the queries, a task's arrays grow no faster than they: when scores of a whole
    batch were held for all queries, they grew 14 times. The rows are the SQL's over many tiles with equal scores."""
    frame, peak = type(spark.range(1)), spark.sparkContext.accumulator(0)

    def traced(self, task, schema, *more, plain=frame.mapInArrow):
        def run(batches):
            np.asarray(pa.array(np.zeros(1)))  # modules that a worker loads at first use are no arrays of the task
            tracemalloc.start()
            try:
                yield from task(batches)
                peak.add(tracemalloc.get_traced_memory()[1])
            finally:
                tracemalloc.stop()

        return plain(self, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", traced)
    peaks = []
    small, large = _made(tmp_path / "small", 2000), _made(tmp_path / "large", 8000)
    for d in (small, large):
        peak.value = 0
        found = catalogue.QUERIES[name](spark, d)
        rows = [tuple(r) for r in found.collect()]
        peaks.append(peak.value)
    assert 0 < peaks[1] <= 4 * peaks[0], peaks
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "customer", "events"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA if t == 'events' else large}/{t}.parquet'")
    want = duck.sql(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(_plain, rows)) == sorted(map(_plain, want)) and len(want) >= 80


def test_walks_go_in_groups(spark, monkeypatch):
    monkeypatch.setattr(G, "WALKS", 7)
    r = np.random.default_rng(6)
    rows = r.normal(size=(400, 8)).astype(np.float32)
    base = spark.createDataFrame([(k, 0, [float(x) for x in v]) for k, v in enumerate(rows)], "paper_id long, idx long, embedding array<float>")
    queries = spark.createDataFrame([(k, [float(x) for x in rows[k]]) for k in range(0, 400, 8)], "query_id long, vector array<double>")
    got = G.GraphIndex(G.build(base)).search(queries, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.top_matches(queries, base, 4).collect()))


def test_numbers_of_six_digits_keep_their_own_ids(spark, tmp_path):
    """Paper 100007 is not paper 7, and an author's paper 100006 is not paper 10000."""
    for name in ("documents", "customer"):
        t = pq.read_table(f"{DATA}/{name}.parquet")
        if name == "documents":
            at = t.column_names.index("doc_id")
            t = t.slice(0, 200).set_column(at, t.field(at), np.array([7, *range(100_000, 100_199)]).tolist() and [[7, *range(100_000, 100_199)]])
        pq.write_table(t, str(tmp_path / f"{name}.parquet"))
    got = [tuple(r) for r in cases.routed_queries(spark, str(tmp_path)).select("asked", "paper_id").collect()]
    named = {p for p in [7, *range(100_000, 100_199)] for k in (1, 2, 3) if p * k % 97 + 1 == 5}
    assert sorted(got) == sorted([("id", 7), *[("name", p) for p in named]]) and len(named) > 3
    assert "routed_queries" in catalogue.QUERIES
