"""Operators on small tables with pinned values, and properties over random inputs."""

import math
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import schema
from quillon.operators import audit, cache, catalog, chunking, citations, dlq, evaluate, keyword, merge, metrics, ratebudget, recommend, search, trail, vectors, watch
from quillon.sources import feeds, log, providers

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


# -- vectors and search ----------------------------------------------------------------------------


def vector_tables(spark, n=40, dim=8, seed=0):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dim))
    m[n // 2] = m[0]  # a tie
    chunks = spark.createDataFrame([(k // 4, k % 4, [float(x) for x in v]) for k, v in enumerate(m)] + [(99, 0, None)], "paper_id long, idx long, embedding array<float>")
    return m, chunks


def test_top_matches_equal_brute_force(spark, monkeypatch):
    m, chunks = vector_tables(spark)
    queries = spark.createDataFrame([(k, [float(x) for x in m[k]]) for k in (0, 3, 7)] + [(5, None)], "query_id long, vector array<double>")
    unit = m.astype(np.float32).astype(float)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    want = []
    for q in (0, 3, 7):
        scores = np.round(unit @ (m[q] / np.linalg.norm(m[q])), 6)
        order = sorted(range(len(m)), key=lambda k: (-scores[k], k // 4, k % 4))[:6]
        want += [(q, k // 4, k % 4, scores[k]) for k in order]
    assert rows(vectors.top_matches(queries, chunks, 6)) == sorted(want, key=repr)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert rows(vectors.top_matches(queries, chunks.repartition(5), 6)) == sorted(want, key=repr)


def test_neighbors_leave_self_out(spark):
    _, chunks = vector_tables(spark)
    got = vectors.neighbors(spark.createDataFrame([(0,), (5,)], "query_id long"), chunks, 3).collect()
    assert len(got) == 6 and all(r.query_id != r.paper_id for r in got) and {r["rank"] for r in got} == {1, 2, 3}
    assert next(r for r in got if r.query_id == 0 and r["rank"] == 1).paper_id == 5


def test_normalise_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vectors.l2_normalize(F.col("a")).alias("a"), vectors.l2_normalize(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.cosine(F.col("a"), F.col("a")).alias("s")).first()
    assert r.a == pytest.approx([0.6, 0.8]) and r.z == [0.0, 0.0] and r.c is None and r.s == pytest.approx(1)


def test_cell_index_holds_every_row_and_recalls(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(10, 16)) * 3
    m = centers[r.integers(0, 10, 600)] + r.normal(size=(600, 16))
    chunks = spark.createDataFrame([(k // 4, k % 4, [float(x) for x in v]) for k, v in enumerate(m)], "paper_id long, idx long, embedding array<float>")
    index = vectors.CellIndex(chunks, cells=10, sample=300)
    assert index.indexed.count() == 600
    found = total = 0
    for q in range(0, 600, 60):
        exact = set(rows(vectors.top_matches(spark.createDataFrame([(0, [float(x) for x in m[q]])], "query_id long, vector array<double>"), chunks, 10), "paper_id", "idx"))
        found += len(exact & set(rows(index.search(m[q], 10, probes=4), "paper_id", "idx")))
        total += 10
    assert found / total >= 0.9


def test_fusion_is_symmetric_and_keyword_only_hits_show(spark):
    dense = spark.createDataFrame([(1, k, 0, 1.0 - k / 10, k + 1) for k in range(3)], "query_id long, paper_id long, idx long, score double, rank int")
    key = spark.createDataFrame([(1, 2, 1), (1, 9, 2)], "query_id long, paper_id long, krank int")
    got = {r.paper_id: r for r in search.fuse(dense, key).collect()}
    assert got[2].rrf == pytest.approx(1 / 63 + 1 / 61, abs=1e-8) and got[9].keyword and got[9].score is None and got[2].position == 1
    swapped = search.fuse(key.select("query_id", "paper_id", F.lit(0).alias("idx"), F.lit(0.0).alias("score"), F.col("krank").alias("rank")), dense.select("query_id", "paper_id", F.col("rank").alias("krank")))
    assert {r.paper_id: r.rrf for r in swapped.collect()} == {k: r.rrf for k, r in got.items()}


def test_filters_and_requests(spark):
    papers = spark.createDataFrame([(1, ["a", "b"], T0), (2, ["c"], T0 + timedelta(days=2))], "paper_id long, categories array<string>, published_at timestamp")
    ids = lambda f: {r.paper_id for r in f.apply(papers).collect()}
    assert ids(search.Filters()) == ids(search.Filters([])) == {1, 2}
    assert ids(search.Filters(["b", "z"])) == {1} and ids(search.Filters(None, T0 + timedelta(days=2))) == {2}
    assert search.since_for("week", T0) == T0 - timedelta(days=7) and search.since_for("ever", T0) is None
    for bad in (("", 10), ("x" * 2001, 10), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            search.check_request(*bad)


def test_routing(spark):
    papers = spark.createDataFrame([("2609.01234", "T"), ("2609.05678", "U")], "paper_id string, title string")
    authors = spark.createDataFrame([("2609.05678", 0, "José García")], "paper_id string, position int, name string")
    assert rows(search.route("https://arxiv.org/abs/2609.01234v2", papers, authors), "paper_id") == [("2609.01234",)]
    assert rows(search.route("jose garcia", papers, authors), "paper_id") == [("2609.05678",)]
    assert search.route("garcia", papers, authors).count() == 0


def test_hits_join_late(spark):
    found = spark.createDataFrame([(1, 1, 0.87654321)], "query_id long, paper_id long, score double")
    papers = spark.createDataFrame([(1, "T", "A", "c", T0, 2)], "paper_id long, title string, abstract string, primary_category string, published_at timestamp, version int")
    authors = spark.createDataFrame([(1, 1, "B"), (1, 0, "A")], "paper_id long, position int, name string")
    r = search.hits(found, papers, authors).first()
    assert r.score == 0.8765 and r.authors == ["A", "B"] and r.url.endswith("/1")


# -- keyword side ----------------------------------------------------------------------------------


def test_query_grammar():
    assert keyword.parse("running dogs") == [[(False, (("run", 0),)), (False, (("dog", 0),))]]
    assert keyword.parse('"king of the cats" or mice -rats') == [[(False, (("king", 0), ("cat", 3)))], [(False, (("mice", 0),)), (True, (("rat", 0),))]]
    assert keyword.parse("the of") == [] and keyword.parse("or x or") == [[(False, (("x", 0),))]]


def test_web_search(spark):
    papers = spark.createDataFrame(
        [(1, "Running dogs", "big cats run", T0), (2, "Cats", "the big grey cats sleep; dogs run", T0), (3, "Mice", "small mice and rats", T0), (4, "Mice alone", "mice", T0), (5, None, None, T0)],
        "paper_id long, title string, abstract string, published_at timestamp",
    )
    post = keyword.postings(papers)
    ids = lambda q: {r.paper_id for r in keyword.web_search(q, post, papers).collect()}
    assert ids("run dogs") == {1, 2} and ids('"big cats"') == {1} and ids('"big cats" or mice -rats') == {1, 4} and ids("-mice") == set() and ids("the") == set()
    first = keyword.web_search("mice", post, papers).orderBy("krank").first()
    assert first.paper_id == 4


def test_cover_density_prefers_near_terms(spark):
    papers = spark.createDataFrame([(1, "", "alpha beta " + "gap " * 40, T0), (2, "", "alpha " + "gap " * 40 + "beta", T0)], "paper_id long, title string, abstract string, published_at timestamp")
    near, far = sorted(keyword.web_search("alpha beta", keyword.postings(papers), papers).collect(), key=lambda r: r.paper_id)
    assert near["rank"] > far["rank"] > 0


# -- catalogue, cache, watches -----------------------------------------------------------------------


def test_latest_pages(spark):
    papers = spark.createDataFrame([(k, f"t{k}", "c", T0 + timedelta(hours=k), ["a"] if k % 2 else ["b"]) for k in range(7)], "paper_id long, title string, primary_category string, published_at timestamp, categories array<string>")
    page = catalog.latest(papers, 3, 3).collect()
    assert [r.paper_id for r in page] == [3, 2, 1] and page[0].has_next
    assert not catalog.latest(papers, 3, 4).first().has_next and [r.paper_id for r in catalog.latest(papers, 9, 0, ["a"]).collect()] == [5, 3, 1]


def test_catalogue_lookups(spark):
    papers = spark.createDataFrame([(1, "html", T0, "c"), (2, "abstract", T0, "c")], "paper_id long, source string, published_at timestamp, primary_category string")
    chunks = spark.createDataFrame([(1, 0, "abstract"), (1, 1, "1 Introduction"), (1, 2, "1 Introduction"), (1, 3, None)], "paper_id long, idx int, section string")
    authors = spark.createDataFrame([(1, 0, "Ada Éa"), (2, 0, "ADA ea"), (2, 1, "Bob")], "paper_id long, position int, name string")
    assert rows(catalog.sections(chunks)) == [(1, "1 Introduction", 1)] and rows(catalog.intro(chunks)) == [(1, 1)]
    assert rows(catalog.author_counts(authors), "name_norm", "papers") == [("ada ea", 2), ("bob", 1)]
    assert catalog.paper(papers, chunks, authors, 2).first().n_chunks == 0
    assert rows(catalog.unambiguous_names(authors)) == [("ADA ea",), ("Ada Éa",), ("Bob",)]
    r = catalog.newest_age(papers, T0 + timedelta(days=4)).first()
    assert r.age_days == 4 and r.stale


def test_cache(spark):
    stored = spark.createDataFrame([("s", "near", [1.0, 0.1], T0), ("s", "far", [0.0, 1.0], T0), ("other", "x", [1.0, 0.0], T0), ("s", "old", [1.0, 0.0], T0 - timedelta(hours=2))], "scope string, response string, vector array<double>, stored_at timestamp")
    asked = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "none", [1.0, 0.0])], "query_id long, scope string, vector array<double>")
    assert rows(cache.lookup(asked, stored, F.lit(T0)), "query_id", "response") == [(1, "near")]
    assert spark.range(1).select(cache.hit_rate(F.lit(2), F.lit(1))).first()[0] == 0.667 and spark.range(1).select(cache.hit_rate(F.lit(0), F.lit(0))).first()[0] is None


def test_watch_order_and_floor(spark):
    found = spark.createDataFrame([(1, 1, 10, 0.9, False), (1, 2, 11, 0.2, True), (1, 3, 12, 0.2, False), (1, 4, 13, 0.7, False)], "query_id long, position long, paper_id long, score double, keyword boolean")
    papers = spark.createDataFrame([(10, T0), (11, T0 + timedelta(days=2)), (12, T0), (13, T0 + timedelta(days=1))], "paper_id long, ingested_at timestamp")
    watches = spark.createDataFrame([(1, T0 + timedelta(days=1), T0)], "query_id long, seen_at timestamp, created_at timestamp")
    got = watch.matches(watches, found, papers).orderBy("place").collect()
    assert [(r.paper_id, r.is_new) for r in got] == [(11, True), (10, False), (13, False)]
    after = watch.mark_seen(watches, watches, F.lit(T0 + timedelta(days=5)))
    assert after.first().seen_at == T0 + timedelta(days=5)
    wide = papers.withColumnsRenamed({"ingested_at": "published_at"}).withColumns({"title": F.lit("A & <b>"), "abstract": F.lit("text")})
    authors = spark.createDataFrame([(10, k, f"n{k}") for k in range(12)], "paper_id long, position int, name string")
    entries = watch.feed(watch.matches(watches, found, papers), watches, wide, authors)
    assert [len(r.authors) for r in entries.orderBy("entry").collect()] == [0, 0, 10]
    xml = watch.to_atom(entries).first().xml
    assert "A &amp; &lt;b&gt;" in xml and xml.startswith("<feed") and "2024-01-03T00:00:00Z" in xml
    more = watch.create(watches.withColumns({"name": F.lit("w"), "text": F.lit("q"), "categories": F.lit(None).cast("array<string>"), "vector": F.array(F.lit(1.0))}), 2, "my query", [0.5], F.lit(T0), categories=[])
    two = more.where("query_id = 2").first()
    assert two.name == "my query" and two.categories is None and watch.delete(more, 2).count() == 1


# -- trails, citations, recommendations ----------------------------------------------------------------


@pytest.fixture(scope="module")
def small_web(spark):
    vec = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [0.1, 0.9], 5: [-1.0, 0.0]}
    chunks = spark.createDataFrame([(k, 0, v) for k, v in vec.items()], "paper_id long, idx long, embedding array<double>")
    own = spark.createDataFrame([(1, 1, T0), (3, 2, T0 + timedelta(days=1))], "paper_id long, web_id long, added_at timestamp")
    webs = spark.createDataFrame([(1, "one", T0), (2, "two", T0)], "web_id long, name string, created_at timestamp")
    papers = spark.createDataFrame([(k, f"Name{k}: title") for k in vec], "paper_id long, title string")
    return chunks, own, webs, papers


def test_assignment_precedence(spark, small_web):
    chunks, own, webs, _ = small_web
    reads = spark.createDataFrame([(2, None, None), (4, None, None), (5, 1, None), (6, 1, 2), (7, None, 99), (8, None, None)], "paper_id long, via long, web_hint long")
    got = {r.paper_id: (r.web_id, r.how) for r in trail.assign(reads, own, webs, chunks).collect()}
    assert got == {2: (1, "near"), 4: (2, "near"), 5: (1, "via"), 6: (2, "hint"), 7: (None, "new"), 8: (None, "new")}


def test_record_reads(spark, small_web):
    chunks, own, webs, papers = small_web
    reads = spark.createDataFrame(
        [(1, 1, None, None, None, None, T0), (2, 2, None, "odd", "q", None, T0), (3, 2, None, "similar", None, 2, T0 + timedelta(hours=1)), (4, 77, None, None, "a search", None, T0 + timedelta(hours=2)), (5, 78, None, None, None, None, T0 + timedelta(hours=3))],
        "read_id long, paper_id long, via long, kind string, query string, web_hint long, at timestamp",
    )
    new_trail, new_webs = trail.record_reads(reads, own, webs, chunks, papers)
    got = {r.paper_id: (r.web_id, r.kind) for r in new_trail.collect()}
    assert got == {1: (1, None), 3: (2, None), 2: (1, "search"), 77: (3, "search"), 78: (4, None)}
    assert {r.web_id: r.name for r in new_webs.collect()} == {1: "one", 2: "two", 3: "a search", 4: "78"}
    again, _ = trail.record_reads(reads, new_trail, new_webs, chunks, papers)
    assert again.count() == new_trail.count()


def test_trail_edits(spark, small_web):
    _, own, webs, _ = small_web
    left, kept = trail.remove(own, webs, 3)
    assert rows(left, "paper_id") == [(1,)] and rows(kept, "web_id") == [(1,)]
    assert rows(trail.move(own, 3, 1), "web_id") == [(1,), (1,)] and rows(trail.rename(webs, 2, "x"), "name") == [("one",), ("x",)]
    assert trail.delete_web(own, webs, 1)[0].count() == 1
    new = own.unionByName(spark.createDataFrame([(9, 1, T0)], own.schema))
    assert trail.insert_ignore(own, new, "paper_id").count() == 3
    assert [(r.web_id, r.place) for r in trail.activity(own).orderBy("place").collect()] == [(2, 1), (1, 2)]


def test_dwell(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    events = [(1, 1, at(0), True), (1, 1, at(6), False), (1, 1, at(100), True), (1, 1, at(104.5), False), (2, 1, at(0), True), (2, 1, at(9), False), (3, 1, at(0), True)]
    df = spark.createDataFrame(events, "user_id long, paper_id long, ts timestamp, visible boolean")
    assert rows(trail.dwell(df)) == [(1, 1, 10.5)]


def test_citation_records(spark):
    record = '{"references":[{"paperId":"p1","externalIds":{"ArXiv":"2001.00001v2"},"title":"A","year":2020},{"paperId":null,"title":null},{"title":"Only Title","year":null}],"citations":[{"paperId":"c1","title":"C"}]}'
    edges = citations.from_records(spark.createDataFrame([("x", record), ("y", None)], "paper_id string, record string"))
    assert rows(edges, "direction", "other_key", "other_id") == [("cited_by", "s2:c1", None), ("cites", "arxiv:2001.00001", "2001.00001"), ("cites", "title:only title", None)]
    many = '{"references":[' + ",".join('{"paperId":"p%d"}' % k for k in range(600)) + "]}"
    assert citations.from_records(spark.createDataFrame([("x", many)], "paper_id string, record string")).count() == 500
    papers = spark.createDataFrame([("7", "ONLY title!"), ("8", "only TITLE")], "paper_id string, title string")
    assert ("arxiv:8", "8") in rows(citations.resolve_titles(edges, papers), "other_key", "other_id")
    twice = edges.unionByName(edges.withColumn("position", F.col("position") + 10))
    assert citations.unique_edges(twice).count() == 3 and citations.counts(twice).first().n_refs == 4
    stored = citations.store(edges.withColumn("paper_id", F.lit("z")), edges)
    assert stored.count() == 6 and citations.store(stored, edges.limit(1)).count() == 4


def test_citation_status(spark):
    papers = spark.createDataFrame([(k,) for k in range(6)], "paper_id int")
    edges = spark.createDataFrame([(0, "cites", "api"), (1, "cited_by", "api"), (5, "cites", "html")], "paper_id int, direction string, via string")
    fetched = spark.createDataFrame([(0, True, "none"), (1, True, "failed"), (2, True, "none"), (3, False, "none"), (4, True, "failed"), (5, True, "ok")], "paper_id int, api_ok boolean, html string")
    assert rows(citations.status(papers, edges, fetched)) == [(0, "done"), (1, "failed"), (2, "missing"), (3, "partial"), (4, "failed"), (5, "done")]
    cached = spark.createDataFrame([(1, "done", T0), (2, "failed", T0), (3, "partial", T0 + timedelta(days=2))], "paper_id int, status string, fetched_at timestamp")
    assert rows(citations.fresh(cached, F.lit(T0 + timedelta(days=2)))) == [(1,), (3,)]


def test_shared_reference_scores(spark):
    """A reference of both papers of a path scores .35 of the newer and .35 * .85 of the older."""
    own = spark.createDataFrame([(1, 1, T0), (1, 2, T0 + timedelta(days=1))], "web_id long, paper_id long, added_at timestamp")
    cited = spark.createDataFrame([(1, "cites", "s2:x", None), (2, "cites", "s2:x", None), (2, "cited_by", "arxiv:7", 7)], "paper_id long, direction string, other_key string, other_id long")
    chunks = spark.createDataFrame([], "paper_id long, idx long, embedding array<double>")
    got = {r.key: r for r in recommend.scored(recommend.reasons(own, cited, chunks)).collect()}
    assert got["s2:x"].score == pytest.approx(0.35 + 0.35 * 0.85, abs=1e-6) and got["s2:x"].n_reasons == 2 and got["s2:x"].source == 2
    assert got["arxiv:7"].score == pytest.approx(0.6)


def greedy(cands, limit):
    ranked = sorted(cands, key=lambda c: (-c[2], c[0]))
    cap = max(4, math.ceil(limit / max(1, len({c[3] for c in ranked}))))
    outside, per, chosen = max(1, round(limit * 0.34)), {}, []
    n_out = 0
    for key, other, _, source in ranked:
        if per.get(source, 0) >= cap or (other is None and n_out >= outside):
            continue
        chosen.append(key)
        per[source] = per.get(source, 0) + 1
        n_out += other is None
        if len(chosen) == limit:
            break
    return chosen


@QUICK
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans(), st.integers(1, 30), st.integers(0, 4)), min_size=1, max_size=40, unique_by=lambda x: x[0]), st.integers(4, 15))
def test_pick_equals_the_greedy_rule(spark, items, limit):
    cands = [(f"k{k:02d}", None if outside else k, score / 10, source) for k, outside, score, source in items]
    df = spark.createDataFrame([(1, *c) for c in cands], "web_id long, key string, other_id long, score double, source long")
    got = [r.key for r in recommend.pick(df, limit).orderBy("place").collect()]
    assert got == greedy(cands, limit)


def test_exclusions_edges_and_strength(spark):
    own = spark.createDataFrame([(1, 5, T0)], "web_id long, paper_id long, added_at timestamp")
    cands = spark.createDataFrame([(1, "arxiv:5", 5, 1.0, 1), (1, "s2:a", None, 0.5, 1), (1, "arxiv:6", 6, 2.0, 1)], "web_id long, key string, other_id long, score double, source long")
    gone = spark.createDataFrame([("s2:a",)], "key string")
    assert rows(recommend.without(cands, own, gone), "key") == [("arxiv:6",)]
    assert {r.key: r.strength for r in recommend.strength(cands).collect()} == {"arxiv:5": round(math.sqrt(0.5), 6), "s2:a": 0.5, "arxiv:6": 1.0}
    edges = spark.createDataFrame([(1, "a", "b", "similar"), (1, "b", "a", "trail"), (1, "a", "b", "builds_on"), (1, "c", "d", "similar")], "web_id long, source string, target string, type string")
    assert rows(recommend.collapse(edges), "source", "target", "type") == [("b", "a", "trail"), ("c", "d", "similar")]
    papers = spark.createDataFrame([(5, "Five"), (6, "Six")], "paper_id long, title string")
    nodes = recommend.graph_nodes(own, recommend.pick(cands), papers)
    assert ("s2:a", "suggestion", False) in rows(nodes, "id", "kind", "in_index") and ("5", "path", True) in rows(nodes, "id", "kind", "in_index")
    assert recommend.pending(own, spark.createDataFrame([], "paper_id long")).first().pending == 1


# -- merges --------------------------------------------------------------------------------------------

PAPER_COLUMNS = "paper_id string, version int, source string, summary string, ingested_at timestamp, processed_at timestamp"


def test_merge_order_does_not_matter(spark):
    """Arrivals of one version in any order, and versions in theirs, end alike."""
    first = [("a", 1, "abstract", None, T0, T0), ("a", 1, "html", "s", T0, T0)]
    second = [("a", 2, "abstract", None, T0, T0), ("a", 2, "pdf", None, T0, T0)]
    arrivals, ends = first + second, set()
    for order in [x + y for x in permutations(first) for y in permutations(second)]:
        table = spark.createDataFrame([], PAPER_COLUMNS)
        for one in order:
            table = spark.createDataFrame(merge.upsert_papers(table, spark.createDataFrame([one], PAPER_COLUMNS)).collect(), PAPER_COLUMNS)
        ends |= {(r.version, r.source) for r in table.collect()}
    assert ends == {(2, "pdf")}
    assert rows(merge.newest(spark.createDataFrame(arrivals, PAPER_COLUMNS)), "version", "source") == [(2, "pdf")]


def test_merge_keeps_summary_and_first_time(spark):
    old = spark.createDataFrame([("a", 1, "html", "kept", T0, T0)], PAPER_COLUMNS)
    new = spark.createDataFrame([("a", 2, "html", None, T0 + timedelta(days=1), T0 + timedelta(days=1)), ("b", 1, "pdf", "x", T0, T0)], PAPER_COLUMNS)
    got = {r.paper_id: r for r in merge.upsert_papers(old, new).collect()}
    assert got["a"].summary == "kept" and got["a"].ingested_at == T0 and got["a"].processed_at == T0 + timedelta(days=1) and got["a"].version == 2 and len(got) == 2


def test_authors_chunks_latest(spark):
    names = spark.createDataFrame([("p", 0, "José", T0), ("p", 2, "jose", T0), ("q", 0, "JOSÉ", T0 - timedelta(days=1))], "paper_id string, position int, name string, seen_at timestamp")
    people, bridge = merge.upsert_authors(names)
    assert rows(people) == [("jose", "JOSÉ")] and rows(bridge) == [("p", "jose", 0), ("q", "jose", 0)]
    chunks = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0)], "paper_id string, idx int")
    assert rows(merge.replace_by_paper(chunks, spark.createDataFrame([("p", 0)], "paper_id string, idx int"))) == [("p", 0), ("q", 0)]
    figs = spark.createDataFrame([("p", 1, 2, "old")], "paper_id string, version int, parser int, status string")
    newer = spark.createDataFrame([("p", 1, 2, "same"), ("q", 1, 1, "new")], figs.schema)
    assert rows(merge.latest_wins(figs, newer, ["paper_id"], ["version", "parser"]), "paper_id", "status") == [("p", "same"), ("q", "new")]


def test_job_claims(spark):
    now = T0 + timedelta(hours=1)
    jobs = spark.createDataFrame([("a", "l", 1, "m", 3, "failed", T0), ("b", "l", 1, "m", 3, "running", T0), ("c", "l", 1, "m", 3, "running", now), ("d", "l", 1, "m", 3, "done", T0), ("e", "l", 1, "m", 2, "done", T0)], "paper_id string, provider string, version int, model string, prompt_version int, status string, started_at timestamp")
    claims = spark.createDataFrame([(k, "l", 1, "m", 3) for k in "abcdef"], "paper_id string, provider string, version int, model string, prompt_version int")
    assert rows(merge.claimable(jobs, claims, F.lit(now)), "paper_id") == [("a",), ("b",), ("e",), ("f",)]
    after = merge.claim(jobs, claims, F.lit(now))
    assert {r.paper_id: r.status for r in after.collect()} == {"a": "running", "b": "running", "c": "running", "d": "done", "e": "running", "f": "running"}
    done = merge.finish(after, spark.createDataFrame([("a", "l", "done")], "paper_id string, provider string, new_status string"), F.lit(now))
    assert {r.paper_id for r in done.where("status = 'done' and finished_at is not null").collect()} == {"a"}


def test_dead_letters(spark):
    failed = spark.createDataFrame(
        [("a", "worker", T0, 0, '{"title":"t","version":1}'), ("a", "worker", T0, 1, '{"x":1}'), ("b", "fetcher", T0, 2, '{"title":"t","version":1}'), ("c", "worker", T0, 3, '{"chunks":[],"paper":{"version":2}}'), ("d", "worker", T0, 4, '{"x":1}')],
        "paper_id string, stage string, failed_at timestamp, offset long, payload string",
    )
    papers = spark.createDataFrame([("a", 1, "abstract"), ("b", 1, "abstract"), ("c", 1, "html")], "paper_id string, version int, source string")
    want = [("a", "resolved (stored, source=abstract)", None), ("b", "replay", "papers.new"), ("c", "replay", "papers.chunked"), ("d", "unreplayable", None)]
    assert rows(dlq.replay_plan(failed, papers)) == want
    bad = dlq.replay_plan(failed, papers, F.when(F.col("paper_id") == "b", F.lit("title is empty")))
    assert ("b", "invalid payload (title is empty)", None) in rows(bad)
    letters = dlq.dead_letter(spark.createDataFrame([("a", "e" * 3000, 0, "{}")], "paper_id string, error string, attempts int, payload string"), "worker", F.lit(T0)).first()
    assert len(letters.error) == 2000 and letters.attempts == 1


def test_audits(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id int")
    chunks = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 0), (9, 0)], "paper_id int, idx int")
    authors = spark.createDataFrame([(1,)], "paper_id int")
    assert rows(audit.summary(papers, chunks, authors)) == [("duplicate_chunks", 1), ("gappy_papers", 2), ("orphan_chunks", 1), ("papers_without_authors", 1)]
    assert audit.log_matches_seen(papers, authors).first().equal is False
    made = spark.createDataFrame([("t", 0, 9), ("t", 1, 4)], "topic string, partition int, offset long")
    read = spark.createDataFrame([("g", "t", 0, 7), ("g", "t", 1, 5)], "consumer string, topic string, partition int, offset long")
    assert rows(audit.consumer_lag(made, read)) == [("t", "g", 3)]


# -- measures --------------------------------------------------------------------------------------------


def test_retrieval_metrics(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 3), (3, 9, 12)], "query_id long, paper_id long, rank int")
    want = spark.createDataFrame([(1, 5), (2, 7), (3, 1), (4, 2)], "query_id long, paper_id long")
    r = evaluate.retrieval_metrics(evaluate.ranks(found, want)).first()
    assert (r.n, r.recall_1, r.recall_5, r.recall_k) == (4, 0.25, 0.5, 0.5) and r.mrr == pytest.approx((1 + 1 / 3) / 4, abs=1e-6)


@QUICK
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40))
def test_percentiles_are_nearest_rank(spark, values):
    r = evaluate.percentiles(spark.createDataFrame([(float(v),) for v in values], "ms double"), "ms").first()
    at = lambda p: sorted(values)[math.ceil(p * len(values)) - 1]
    assert (r.p50, r.p95, r.p99) == (at(0.5), at(0.95), at(0.99))


def test_other_summaries(spark):
    designs = spark.createDataFrame([(1, 2.0, [("term",), ("result",)], 1), (2, 4.0, [("term",)], 0), (3, 9.0, [], 2)], "paper_id int, seconds double, rejected array<struct<kind:string>>, evidence_kept int")
    assert rows(evaluate.scorecard(designs), "kind", "rejected", "designs", "median_seconds") == [("result", 1, 3, 4.0), ("term", 2, 3, 4.0)]
    polls = spark.createDataFrame([(1, "c", 1, 5, 5, T0, 2), (1, "c", 2, 5, 1, T0 - timedelta(days=1), 2)], "cycle int, category string, page int, fetched int, new int, oldest timestamp, cap int")
    r = evaluate.poll_summary(polls).first()
    assert (r.fetched, r.produced, r.duplicates, r.capped) == (10, 6, 4, True)


@QUICK
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=30), st.integers(1, 900))
def test_slots_equal_the_loop(spark, arrivals, interval):
    arrivals = sorted(arrivals)
    want, last = [], None
    for a in arrivals:
        last = a if last is None else max(last + interval, a)
        want.append(last)
    df = spark.createDataFrame([(k, 1, a) for k, a in enumerate(arrivals)], "id long, key long, at_ms long")
    assert [r.slot_ms for r in ratebudget.slots(df, interval).orderBy("id").collect()] == want


def test_limiter_spaces_calls():
    clock = [0.0]
    limiter = ratebudget.Limiter(3.0, 0.05, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    times = []
    for _ in range(4):
        limiter.wait()
        times.append(clock[0])
    assert np.allclose(np.diff(times), 3.05)


def test_gaps(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 3000, 6100, 9000)], "key long, at_ms long")
    r = ratebudget.gaps(df, 3000).first()
    assert (r.n, r.least, r.median, r.most, r.under) == (3, 2900, 3000, 3100, 1)


def test_counters_and_histograms(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    samples = spark.createDataFrame([("a", at(0), 5.0), ("a", at(20), 8.0), ("a", at(40), 2.0)], "series string, ts timestamp, value double")
    assert [r.inc for r in metrics.increases(samples, ["series"]).orderBy("ts").collect()] == [0.0, 3.0, 2.0]
    assert metrics.rate(samples, ["series"], [], "1 minute").first().rate == pytest.approx(5 / 60, abs=1e-6)
    cells = spark.createDataFrame([("x", 1.0, 10.0), ("x", 2.0, 30.0), ("x", math.inf, 40.0)], "job string, le double, count double")
    q = lambda p: metrics.histogram_quantile(cells, p, ["job"]).first()["quantile"]
    assert q(0.5) == 1.5 and q(0.25) == 1.0 and q(0.99) == 2.0


# -- passages --------------------------------------------------------------------------------------------


@QUICK
@given(st.integers(0, 60), st.integers(4, 20), st.integers(0, 3))
def test_chunk_windows_cover(spark, n, tokens, overlap):
    words = [f"w{k}" for k in range(1, n + 1)]
    df = spark.createDataFrame([(1, 0, "T", " ".join(words))], "paper_id long, place long, title string, text string")
    got = sorted((r.start, r.text.split()) for r in chunking.windows(df, tokens, overlap).collect())
    want, start = [], 0
    while n >= chunking.LEAST and start < n:
        want.append((start, words[start : start + tokens]))
        if start + tokens >= n:
            break
        start += tokens - overlap
    assert got == want
    spans = lambda t: [m.span() for m in __import__("re").finditer(r"\S+", t)]
    assert sorted((r.start, r.text.split()) for r in chunking.token_chunks(df, spans, tokens, overlap).collect()) == want


def test_chunks_of_a_paper(spark):
    papers = spark.createDataFrame([(1, "T", "abs tract")], "paper_id long, title string, abstract string")
    sections = spark.createDataFrame([(1, 0, "A", " ".join(map(str, range(25)))), (1, 1, "B", "too few"), (1, 2, "C", " ".join(map(str, range(10))))], "paper_id long, place long, title string, text string")
    got = chunking.chunks(papers, sections, 10, 3, most=5).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 1, 2, 3, 4] and got[0].text == "T\n\nabs tract" and got[0].token_count == 3
    assert got[1].text.startswith("A\n0 1") and [r.section for r in got] == ["abstract", "A", "A", "A", "A"]


# -- sources ---------------------------------------------------------------------------------------------

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><opensearch:totalResults>42</opensearch:totalResults>
<entry><id>http://arxiv.org/abs/2609.01234v2</id><title>A
  Title</title><summary> Some  text </summary><published>2026-09-01T00:00:00Z</published><updated>2026-09-02T01:00:00+01:00</updated><author><name>Ada  L</name></author><author><name> </name></author>
<category term="cs.CV"/><arxiv:primary_category term="cs.LG"/><link title="pdf" href="http://arxiv.org/pdf/2609.01234v2"/><link title="doi" href="http://dx.doi.org/10.1/abc"/></entry>
<entry><id>http://arxiv.org/abs/hep-th/9901001v1</id><title>Old</title><summary>x</summary><published>1999-01-01T00:00:00Z</published><updated>1999-01-01T00:00:00Z</updated><category term="hep-th"/></entry>
<entry><id>http://arxiv.org/abs/2609.09999</id><title>bad</title><summary>no version</summary></entry><entry><id>http://arxiv.org/api/errors#x</id><title>Error</title><summary>e</summary></entry></feed>"""
HARVEST = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>2609.00001</id><created>2026-09-01</created><title>T</title><abstract>A  b</abstract><categories>cs.CV cs.LG</categories>
<authors><author><keyname>Lovelace</keyname><forenames>Ada</forenames></author><author><keyname>Plato</keyname></author></authors></arXiv></metadata></record><record><header status="deleted"/></record><resumptionToken>tok</resumptionToken></ListRecords></OAI-PMH>"""


def test_atom():
    total, papers, errors = feeds.parse_atom(FEED, "2026-09-03T00:00:00Z")
    assert total == 42 and len(errors) == 1 and [p["arxiv_id"] for p in papers] == ["2609.01234", "hep-th/9901001"]
    p = papers[0]
    assert (p["title"], p["abstract"], p["version"], p["authors"], p["categories"], p["doi"]) == ("A Title", "Some text", 2, ["Ada L"], ["cs.LG", "cs.CV"], "10.1/abc")
    assert p["pdf_url"] == "https://arxiv.org/pdf/2609.01234v2" and p["updated_at"] == "2026-09-02T00:00:00Z" and papers[1]["pdf_url"].endswith("hep-th/9901001v1")


def test_feeds_as_tables(spark):
    pages = spark.createDataFrame([(FEED, "2026-09-03T00:00:00Z"), ("no xml", "2026-09-03T00:00:00Z"), (None, None)], "xml string, polled_at string")
    papers = feeds.papers_of_pages(pages)
    assert rows(papers, "arxiv_id", "version") == [("2609.01234", 2), ("hep-th/9901001", 1)]
    seen = spark.createDataFrame([("2609.01234v2",)], "member string")
    assert rows(feeds.unseen(papers, seen), "arxiv_id") == [("hep-th/9901001",)] and feeds.in_categories(papers, ["cs.CV"]).count() == 1
    harvest = feeds.papers_of_pages(spark.createDataFrame([(HARVEST, "2026-09-03T00:00:00Z")], "xml string, polled_at string"), "harvest").first()
    assert harvest.authors == ["Ada Lovelace", "Plato"] and harvest.version == 1 and harvest.primary_category == "cs.CV" and feeds.parse_harvest(HARVEST, "2026-09-03")[1] == "tok"
    walked = spark.createDataFrame([("c", 1, 5), ("c", 2, 0), ("c", 3, 4)], "category string, page int, new int")
    assert rows(feeds.walk(walked), "page") == [(1,), (2,)]


def test_message_schemas(spark):
    _, papers, _ = feeds.parse_atom(FEED, "2026-09-03T00:00:00Z")
    import json

    good = papers[0]
    cases = [(good, None), (good | {"arxiv_id": "bad id"}, "arxiv_id does not match"), ({k: v for k, v in good.items() if k != "title"}, "title is missing or of another type"), (good | {"extra": 1}, "unexpected field"), (good | {"version": 0}, "version is under 1"), (good | {"categories": []}, "categories is empty"), (good | {"polled_at": "soon"}, "polled_at is no date-time"), (good | {"doi": None}, None)]
    df = spark.createDataFrame([(k, json.dumps(m)) for k, (m, _) in enumerate(cases)] + [(99, "[1"), (98, "text")], "k int, v string")
    got = {r.k: r.x for r in df.select("k", schema.paper_violation(F.col("v")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases] and got[99] and got[98]
    full = {"schema_version": 1, "paper": good, "source": "html", "chunks": [{"idx": 0, "section": None, "text": "x", "token_count": 1}], "fetched_at": "2026-09-03T00:00:00Z"}
    failed = {"schema_version": 1, "arxiv_id": "x", "stage": "worker", "error": "e", "attempts": 1, "failed_at": "2026-09-03T00:00:00Z", "payload": {"a": 1}}
    more = [("chunked", full, None), ("chunked", full | {"source": "doc"}, "source is not one of html, pdf, abstract"), ("chunked", full | {"chunks": []}, "chunks is empty"), ("chunked", full | {"paper": good | {"version": 0}}, "paper.version is under 1"), ("failed", failed, None), ("failed", failed | {"stage": "x"}, "stage is not one of fetcher, worker"), ("odd", {}, "unknown kind")]
    df = spark.createDataFrame([(k, kind, json.dumps(m)) for k, (kind, m, _) in enumerate(more)], "k int, kind string, v string")
    got = {r.k: r.x for r in df.select("k", schema.violation(F.col("kind"), F.col("v")).alias("x")).collect()}
    assert [got[k] for k in range(len(more))] == [w for *_, w in more]


def test_providers(spark):
    assert providers.ordered([{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}], 2, 2) == [[0.6, 0.8], [0.0, 1.0]]
    for bad in ([{"index": 0, "embedding": [1, 2]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1]}]):
        with pytest.raises(ValueError):
            providers.ordered(bad, 2, 2)
    texts = spark.createDataFrame([(k, f"some text {k % 2}") for k in range(150)], "paper_id long, text string")
    got = providers.embed(texts, providers.HashEmbedder(16)).collect()
    assert len(got) == 150 and got[0].embedding == got[2].embedding and sum(x * x for x in got[0].embedding) == pytest.approx(1, rel=1e-5)
    tries = []

    def flaky():
        tries.append(1)
        raise providers.Transient("busy")

    assert providers.attempt(flaky) == (None, "Transient: busy", 3) and len(tries) == 3
    assert providers.attempt(lambda: 1 / 0)[2] == 1 and providers.attempt(lambda: 5) == (5, None, 1)
    assert providers.retryable(429) and providers.retryable(503) and not providers.retryable(404)
    papers = spark.createDataFrame([(1, "T", "First. Second."), (2, "", "")], "paper_id long, title string, abstract string")
    chunks = spark.createDataFrame([(1, 1, "Introduction", "x")], "paper_id long, idx int, section string, text string")
    assert rows(providers.summarize(papers, chunks, providers.LeadSummarizer())) == [(1, "First", None), (2, None, "blank summary")]
    assert providers.complete_json(lambda n: {"content": "{" if n == 0 else '{"a": 1}', "finish_reason": "stop"}, ["a"]) == {"a": 1}
    with pytest.raises(ValueError):
        providers.complete_json(lambda n: {"content": '{"a": 1}', "finish_reason": "length"}, ["a"])


def test_pages_and_pdfs(spark, tmp_path):
    pages = spark.createDataFrame([(200, "x ltx_document"), (200, "other"), (404, None), (500, None), (200, None)], "http int, html string")
    assert rows(providers.html_status(pages), "status") == [("done",), ("failed",), ("none",), ("none",), ("none",)]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF" + b"x" * 100)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in providers.valid_pdfs(files, 50).select("path").collect()] == ["a.pdf"]


def test_logs(spark, tmp_path):
    messages = spark.createDataFrame([(f"k{k % 5}", str(k)) for k in range(20)], "key string, value string")
    path = str(tmp_path / "log")
    log.append(log.records(messages, "t", F.lit(T0)), path)
    got = log.read_all(spark, path, "t")
    assert got.count() == 20 and got.groupBy("key").agg(F.countDistinct("partition").alias("n")).where("n <> 1").count() == 0
    ends = got.groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    log.append(log.records(messages, "t", F.lit(T0), first=ends), path)
    assert log.read_all(spark, path).groupBy("partition", "offset").count().where("count > 1").count() == 0 and log.read_all(spark, path, "other").count() == 0


def feed_page(keys, total):
    entry = "<entry><id>http://arxiv.org/abs/{k}v1</id><title>T</title><summary>s</summary><published>2026-09-01T00:00:00Z</published><updated>2026-09-0{d}T00:00:00Z</updated><category term='c'/></entry>"
    body = "".join(entry.format(k=k, d=9 - n % 8) for n, k in enumerate(keys))
    return f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>{total}</o:totalResults>{body}</feed>'


def test_paged_walk():
    from quillon.sources import poll

    keys = [f"2609.{k:05d}" for k in range(50)]
    fetch = lambda c, start, size: feed_page(keys[start : start + size], len(keys))
    seen = {f"{k}v1" for k in keys[25:]}
    last, got = None, []
    for state, papers in poll.walk("c", fetch, seen, "2026-09-10T00:00:00Z", page=10):
        got += [p["arxiv_id"] for p in papers]
        last = state
    assert got == keys[:25] and last.fetched == 40 and last.duplicates == 15 and not last.capped and len(seen) == 50
    capped = list(poll.walk("c", fetch, set(), "2026-09-10T00:00:00Z", page=10, max_pages=2))[-1][0]
    assert capped.capped and capped.oldest == "2026-09-02T00:00:00Z"

    def broken(c, start, size):
        if start:
            raise poll.Transient("503")
        return fetch(c, start, size)

    parts = list(poll.walk("c", broken, set(), "2026-09-10T00:00:00Z", page=10))
    assert len(parts[0][1]) == 10 and parts[-1][0].error == "Transient: 503"
    lost = set()
    next(poll.walk("c", fetch, lost, "2026-09-10T00:00:00Z", page=10))
    assert not lost


def test_feed_source(spark, tmp_path):
    from quillon.sources import poll

    for category, n in (("a", 2), ("b", 1)):
        (tmp_path / category).mkdir()
        for k in range(n):
            (tmp_path / category / f"{k * 5}.xml").write_text(feed_page([f"2609.{k:05d}"], 2))
    raw = poll.pages(spark, tmp_path.as_uri(), ["a", "b"], size=5)
    assert rows(raw, "category", "start") == [("a", 0), ("a", 5), ("b", 0)]
    papers = feeds.papers_of_pages(raw.withColumn("polled_at", F.lit("2026-09-10T00:00:00Z")))
    assert papers.count() == 3


def test_outside_tools(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF good")
    (tmp_path / "b.pdf").write_bytes(b"%PDF slow")

    def convert(content):
        if b"slow" in content:
            raise TimeoutError("90 s")
        return content.decode()[5:]

    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.path[-5:], r.text, r.error) for r in providers.pdf_texts(files, convert).collect()) == [("a.pdf", "good", None), ("b.pdf", None, "TimeoutError: 90 s")]

    def fetch(ids):
        if len(ids) > 3:
            raise ValueError("too many")
        return [{"paperId": i} if i != "2" else None for i in ids]

    papers = spark.range(7).select(F.col("id").alias("paper_id")).coalesce(1)
    got = {r.paper_id: (r.record, r.error) for r in providers.citation_records(papers, fetch, 3).collect()}
    assert got["2"] == (None, None) and got["0"][0] == '{"paperId": "0"}' and len(got) == 7
    assert all(r.error for r in providers.citation_records(papers, lambda ids: [], 3).collect())


def test_keyword_side_off(spark):
    _, chunks = vector_tables(spark)
    papers = spark.createDataFrame([(k, f"word{k}", "text", T0, ["c"]) for k in range(10)], "paper_id long, title string, abstract string, published_at timestamp, categories array<string>")
    queries = chunks.where("paper_id = 1 and idx = 0").select(F.lit(1).cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    texts = spark.createDataFrame([(1, "word7")], "query_id long, text string")
    plain = search.answer(queries, texts, chunks, papers, 5, keyword=False)
    assert plain.columns == search.answer(queries, texts, chunks, papers, 5).columns and not any(r.keyword for r in plain.collect())
    both = {r.paper_id: r.keyword for r in search.answer(queries, texts, chunks, papers, 10).collect()}
    assert both[7] and search.answer(queries, None, chunks, papers, 5).count() == 5
