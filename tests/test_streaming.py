"""Streaming ingestion, stateful deduplication and dwell times."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillon import schema
from quillon.operators import audit
from quillon.operators.metrics import rate
from quillon.sources import log
from quillon.sources.providers import HashEmbedder
from quillon.streaming import dedup, ingest

T0 = datetime(2026, 9, 1)


def paper(key, version=1, **more):
    return {
        "schema_version": 1, "arxiv_id": key, "version": version, "title": f"Title {key}", "abstract": "Some text.", "authors": ["Ada", "Bob", "Ada"], "primary_category": "cs.CV", "categories": ["cs.CV"], "published_at": "2026-09-01T00:00:00Z",
        "updated_at": "2026-09-01T00:00:00Z", "pdf_url": "https://x/y", "html_url": None, "doi": None, "journal_ref": None, "comment": None, "polled_at": "2026-09-01T00:00:00Z", **more,
    }


def full(key, version=1, n=3):
    chunks = [{"idx": k, "section": "abstract" if k == 0 else "1 Intro", "text": f"passage {k}", "token_count": 2} for k in range(n)]
    return {"schema_version": 1, "paper": paper(key, version), "source": "html", "chunks": chunks, "fetched_at": "2026-09-01T00:00:00Z"}


def run(spark, tmp_path, batches):
    path = str(tmp_path / "log")
    for k, batch in enumerate(batches):
        messages = spark.createDataFrame([(key, m if isinstance(m, str) else json.dumps(m)) for key, m in batch], "key string, value string")
        log.records(messages, "papers", F.lit(T0 + timedelta(hours=k))).coalesce(1).write.mode("append").parquet(path)
        tables = ingest.Tables(spark, str(tmp_path / "tables"))
        query = ingest.start(log.stream(spark, path), tables, HashEmbedder(8), str(tmp_path / "check"), lambda i: F.lit(T0 + timedelta(hours=i)))
        query.awaitTermination()
    return tables


def test_any_order_gives_the_same_tables(spark, tmp_path):
    a, b, c = ("2609.00001", paper("2609.00001")), ("2609.00001", full("2609.00001")), ("2609.00002", paper("2609.00002"))
    ends = []
    for k, order in enumerate(([[a, c], [b]], [[b], [a, c]], [[a, b, c]])):
        tables = run(spark, tmp_path / str(k), order)
        papers, chunks = tables.read("papers", schema.PAPERS_TABLE), tables.read("chunks", schema.CHUNKS_TABLE)
        authors = tables.read("authors", "paper_id string, position int, name string")
        ends.append((sorted((r.paper_id, r.version, r.source) for r in papers.collect()), sorted((r.paper_id, r.idx, r.text) for r in chunks.collect()), sorted((r.paper_id, r.name) for r in authors.collect())))
        assert {r.n for r in audit.summary(papers, chunks, authors).collect()} == {0}
        assert all(len(r.embedding) == 8 for r in chunks.collect())
    assert ends[0] == ends[1] == ends[2]
    assert ends[0][0] == [("2609.00001", 1, "html"), ("2609.00002", 1, "abstract")] and len(ends[0][1]) == 4


def test_bad_messages_become_dead_letters(spark, tmp_path):
    tables = run(spark, tmp_path, [[("x", "not json"), ("2609.00003", paper("2609.00003", version=0)), ("2609.00004", paper("2609.00004"))]])
    dead = spark.read.parquet(f"{tables.path}/dead").collect()
    assert sorted(r.error for r in dead) == ["not a JSON object", "version is under 1"] and {r.attempts for r in dead} == {1}
    assert tables.read("papers", schema.PAPERS_TABLE).count() == 1


def stream_of(spark, tmp_path, parts, ddl):
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_first_versions(spark, tmp_path):
    parts = [[("a", 1, T0), ("a", 1, T0)], [("a", 2, T0), ("b", 1, T0), ("a", 1, T0)]]
    ddl = "paper_id string, version int, ts timestamp"
    got = collect(spark, dedup.first_versions(stream_of(spark, tmp_path, parts, ddl)), "firsts")
    assert sorted((r.paper_id, r.version) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    got = collect(spark, dedup.first_versions(stream_of(spark, tmp_path / "w", parts, ddl), late="7 days"), "firsts_late")
    assert len(got) == 3


def test_dwell_stream_over_batches(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[(1, 1, at(0), True), (1, 1, at(6), False), (2, 1, at(0), True)], [(1, 1, at(60), True), (2, 1, at(8), False)], [(1, 1, at(65), False), (1, 1, at(70), True), (1, 1, at(99), False)]]
    got = collect(spark, dedup.dwell_stream(stream_of(spark, tmp_path, parts, "user_id long, paper_id long, ts timestamp, visible boolean")), "dwells")
    assert [(r.user_id, r.paper_id) for r in got] == [(1, 1)] and got[0].seconds >= 10


def test_windowed_counts(spark, tmp_path):
    parts = [[("v", T0), ("v", T0 + timedelta(minutes=1))], [("v", T0 + timedelta(minutes=30))]]
    got = collect(spark, dedup.windowed_counts(stream_of(spark, tmp_path, parts, "event_type string, ts timestamp_ntz")), "counts", "complete")
    assert sorted(r.n for r in got) == [1, 2]


def test_metrics_of_streams(spark, tmp_path):
    import time

    from quillon.streaming import observe

    metrics = observe.Metrics()
    spark.streams.addListener(metrics)
    df = stream_of(spark, tmp_path, [[("a", 1, T0)], [("b", 2, T0)]], "paper_id string, version int, ts timestamp")
    collect(spark, observe.counted(df, "papers", versions=F.sum("version")), "observed")
    for _ in range(50):
        if metrics.totals["papers", "rows"] >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(metrics)
    assert metrics.totals["papers", "rows"] == 2 and metrics.totals["papers", "versions"] == 3
    assert 'quillon_rows_total{name="papers"} 2' in metrics.text()
    assert metrics.flush(spark, str(tmp_path / "samples")) >= 4 and metrics.flush(spark, str(tmp_path / "samples")) == 0
    samples = spark.read.parquet(str(tmp_path / "samples"))
    last = {(r.name, r.metric): r.value for r in samples.groupBy("name", "metric").agg(F.max("value").alias("value")).collect()}
    assert last["papers", "rows"] == 2.0 and last["papers", "versions"] == 3.0
    assert {r.metric for r in rate(samples, ["name", "metric"], ["name", "metric"], "1 day").collect() if r.name == "papers"} == {"rows", "versions"}
    assert observe.snapshot(a=spark.range(3), b=spark.range(2)).first().asDict() == {"a": 3, "b": 2}
