"""Registered queries of single functions, table edits, feeds and logs over the fixture tables, with the SQL that says the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillon.functions import register
from quillon.functions import text as T
from quillon.operators import audit, cache, catalog, citations, dlq, evaluate, merge, recommend, search, trail, vectors, watch
from quillon.plans import views as V
from quillon.plans.queries import NOW, _DENSE, _REASONS, asked, longs, query
from quillon.shared import table
from quillon.sources import feeds, log
from quillon.streaming import dedup

STRING = "string"


def _docs(spark, d):
    return table(spark, d, "documents")


def _turns(spark, d):
    return table(spark, d, "conversations")


def _text(c):
    return F.col(c).cast(STRING)


# -- text ------------------------------------------------------------------------------------------


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '[\s\v\x{a0}]+', ' ', 'g')) AS tidy, left(text, 2000) AS error FROM conversations", views=False)
def clean_text(spark, d):
    odd = F.concat(F.lit("  \x00"), F.regexp_replace("text", " ", "  \t"), F.lit("\x00\n"))
    return _turns(spark, d).select("conv_id", "turn", T.normalize_ws(T.strip_nul(odd)).alias("tidy"), T.error_text(F.col("text")).alias("error"))


@query(
    """
WITH i AS (SELECT doc_id, 1 + doc_id % 9 AS v, '2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS id FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE id END AS parsed, id AS own, v AS version, id || 'v' || v AS versioned FROM i
""",
    views=False,
)
def paper_ids(spark, d):
    v = (1 + F.col("doc_id") % 9).cast("int")
    plain = F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 100000).cast(STRING), 5, "0"))
    full = T.versioned_id(plain, v)
    forms = F.array(plain, full, F.concat(F.lit("arXiv:"), full), F.concat(F.lit("https://arxiv.org/abs/"), full), F.concat(F.lit("http://www.arxiv.org/pdf/"), full, F.lit(".pdf")), F.concat(F.lit("see "), full))
    split = T.split_version(full)
    return _docs(spark, d).select("doc_id", T.parse_paper_id(F.element_at(forms, (F.col("doc_id") % 6 + 1).cast("int"))).alias("parsed"), split["id"].alias("own"), split["version"].cast("long").alias("version"), full.alias("versioned"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%-d %b %Y') AS shown FROM events", views=False)
def message_times(spark, d):
    at = F.col("ts").cast("timestamp")
    show = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, d, "events").select("event_id", T.parse_time(show(at)).alias("at"), T.parse_time(F.date_format(at, "yyyy-MM-dd")).alias("day"))
    return rows.select("event_id", show(F.col("at")).alias("at"), F.date_format("day", "yyyy-MM-dd").alias("day"), T.display_date(F.col("at")).alias("shown"))


@query("SELECT date_diff('day', max(published_at)::DATE, DATE '2024-02-01') AS age_days, date_diff('day', max(published_at)::DATE, DATE '2024-02-01') > 3 AS stale FROM papers")
def newest_age(spark, d):
    return longs(catalog.newest_age(V.papers(spark, d), NOW), "age_days")


@query(
    """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10.1/' || c_custkey WHEN 1 THEN '10.2/' || c_custkey END AS doi, 'https://h.org/' || c_custkey AS link,
  CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE 'F. ' || c_name END AS shown FROM customer
""",
    views=False,
)
def links_and_names(spark, d):
    key, null = _text("c_custkey"), F.lit(None).cast(STRING)
    element = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" 10.1/"), key, F.lit(" ")))
    link = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("http://dx.doi.org/10.2/"), key)).when(F.col("c_custkey") % 3 == 2, F.lit("http://h.org/x"))
    first = F.when(F.col("c_custkey") % 4 != 3, F.lit("F.")).otherwise(null)
    return table(spark, d, "customer").select("c_custkey", T.doi_of(element, link).alias("doi"), T.https(F.concat(F.lit("http://h.org/"), key)).alias("link"), T.display_name(first, F.col("c_name")).alias("shown"))


@query(
    """
SELECT l_orderkey, l_linenumber, year(l_shipdate)::BIGINT AS year, CASE WHEN l_linenumber % 2 = 0 THEN 'Title of ' || l_orderkey || ', part ' || l_linenumber END AS title,
  CASE l_linenumber % 4 WHEN 0 THEN 'arxiv:' || l_orderkey WHEN 1 THEN 's2:' || l_orderkey WHEN 2 THEN 'title:title of ' || l_orderkey END AS key FROM lineitem
""",
    views=False,
)
def reference_texts(spark, d):
    key, null, n = _text("l_orderkey"), F.lit(None).cast(STRING), F.col("l_linenumber") % 4
    title = F.concat(F.lit("Title of "), key)
    text = F.concat(F.lit("A. B. 1901. "), F.when(n % 2 == 0, F.concat(F.lit("“"), title, F.lit(", part "), _text("l_linenumber"), F.lit(",” "))).otherwise(F.lit("")), F.year("l_shipdate").cast(STRING), F.lit(" (12345)"))
    made = T.edge_key(F.when(n == 0, key).otherwise(null), F.when(n == 1, key).otherwise(F.lit("")), F.when(n == 2, F.concat(title, F.lit("!"))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.last_year(text).cast("long").alias("year"), T.quoted_title(text).alias("title"), made.alias("key"))


@query(
    r"""
WITH s AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'Head ' || turn ELSE 'Other' END AS section FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'Head ' || turn || chr(10) || text END AS passage, string_split(text, '. ')[1] AS line,
  'Head ' || turn || chr(10) || chr(10) || text AS body, greatest(1, len(list_filter(regexp_split_to_array('Head ' || turn || ' ' || text, '[\s\v]+'), lambda x: x <> '')))::BIGINT AS token_count FROM s
""",
    views=False,
)
def passages(spark, d):
    head = F.concat(F.lit("Head "), _text("turn"))
    section = F.when(F.col("turn") % 2 == 0, head).otherwise(F.lit("Other"))
    one = T.abstract_chunk(head, F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", T.passage(F.concat(head, F.lit("\n"), F.col("text")), section).alias("passage"), T.one_liner(F.col("text")).alias("line"), one["text"].alias("body"), one["token_count"].cast("long").alias("token_count"))


@query(
    r"""
, s AS (SELECT paper_id, list_filter(string_split(regexp_replace(abstract, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: true) AS parts FROM papers)
SELECT paper_id, left(list_reduce(parts, lambda acc, x: CASE WHEN length(acc) >= 40 THEN acc ELSE trim(acc || ' ' || x, ' ') END, ''), 300) AS sentence FROM s
"""
)
def first_sentence(spark, d):
    return V.papers(spark, d).select("paper_id", T.first_sentence(F.col("abstract")).alias("sentence"))


@query(
    """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor((12 * o_custkey + 60 * o_orderkey) / 40.0 + 0.5) / 100000 WHEN 1 THEN floor((o_custkey + 5 * o_orderkey) / 40.0 + 0.5) / 100000 END AS cost FROM orders
""",
    views=False,
)
def model_costs(spark, d):
    model = F.element_at(F.array(F.lit("large"), F.lit("small"), F.lit("unknown")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.model_cost(model, F.col("o_custkey"), F.col("o_orderkey"), {"large": (3.0, 15.0), "small": (0.25, 1.25)}).cast("double").alias("cost"))


@query(
    r"""
WITH a AS (SELECT doc_id, 1 + doc_id % 50 AS k, list_sort([lang, source]) AS cats, list_sort(list_distinct(list_filter(regexp_extract_all('SAM ' || doc_id || ' and x', '[\w.+-]+'), lambda t: regexp_matches(t, '[0-9]') OR regexp_matches(t, '^.+[A-Z]')))) AS ids FROM documents)
SELECT doc_id, left(sha1(k || '|' || array_to_string(cats, ',') || '||' || array_to_string(ids, ',')), 16) AS scope FROM a
""",
    views=False,
)
def scope_keys(spark, d):
    asked_text = F.concat(F.lit("SAM "), _text("doc_id"), F.lit(" and x"))
    return _docs(spark, d).select("doc_id", T.scope_key(1 + F.col("doc_id") % 50, F.array("source", "lang"), F.lit(None).cast(STRING), asked_text).alias("scope"))


@query(
    """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1] / 1, 6) AS first FROM (
  SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) END AS v FROM embeddings)
""",
    views=False,
)
def unit_vectors(spark, d):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 5 == 0, F.lit(0.0)).otherwise(x.cast("double") * (1 + F.col("vec_id") % 7)))
    v = vectors.l2_normalize(scaled)
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at(v, 1), 6).alias("first"))


@query(
    """
SELECT paper_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm, '2401.' || lpad((paper_id % 100000)::VARCHAR, 5, '0') AS id, round(least(1.0, greatest(0.1, (paper_id % 100 / 100.0 - 0.6) / 0.2)), 6) AS weight FROM papers
"""
)
def registered_functions(spark, d):
    """The SQL names of the functions, called from SQL."""
    register.register(spark)
    V.papers(spark, d).createOrReplaceTempView("quillon_papers")
    return spark.sql(
        "SELECT paper_id, norm_title(title) AS norm, parse_paper_id(concat('https://arxiv.org/abs/2401.', lpad(cast(paper_id % 100000 AS STRING), 5, '0'), 'v2')) AS id, "
        "round(similar_weight(cast(paper_id % 100 AS DOUBLE) / 100), 6) AS weight FROM quillon_papers"
    )


# -- search ----------------------------------------------------------------------------------------


@query(
    _DENSE.replace("{where}", "").replace("SELECT query_id, paper_id, idx, round(score, 4) AS score, rank FROM ranked", "SELECT query_id, rank, paper_id, title, round(score, 4) AS score, 'https://arxiv.org/abs/' || paper_id AS url, (SELECT coalesce(string_agg(name, '; ' ORDER BY position), '') FROM authors a WHERE a.paper_id = ranked.paper_id) AS authors FROM ranked JOIN papers USING (paper_id)")
)
def search_hits(spark, d):
    found = search.dense(asked(spark, d), V.chunks(spark, d), V.papers(spark, d))
    out = search.hits(found, V.papers(spark, d), V.authors(spark, d))
    return longs(out.select("query_id", "rank", "paper_id", "title", "score", "url", F.array_join("authors", "; ").alias("authors")), "rank")


@query(_DENSE.replace("{where}", "WHERE published_at >= TIMESTAMP '2024-01-02 00:00:00'").replace("SELECT query_id, paper_id, idx, round(score, 4) AS score, rank", "SELECT query_id, rank AS position, paper_id, idx, round(score, 4) AS score, NULL::DOUBLE AS rrf, false AS keyword"))
def dense_fallback(spark, d):
    """A search with the keyword side off, over a named window of time."""
    filters = search.Filters([], search.since_for("month", datetime(2024, 2, 1)))
    out = search.answer(asked(spark, d), None, V.chunks(spark, d), V.papers(spark, d), filters=filters, keyword=False)
    return out.withColumn("score", F.round("score", 4))


def _as_2401(rows):
    """paper_id as an id of January 2024: five digits, and all digits of longer numbers, so each paper keeps an id of its own."""
    digits = _text("paper_id")
    return rows.withColumn("paper_id", F.concat(F.lit("2401."), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)))


@query(
    """
SELECT 'id' AS asked, paper_id, title FROM papers WHERE paper_id = 7
UNION ALL SELECT 'name', paper_id, title FROM papers WHERE paper_id IN (SELECT paper_id FROM authors WHERE lower(name) = 'customer#000000005')
"""
)
def routed_queries(spark, d):
    """An id in a link goes to its paper, a name to its author's papers, other texts to nothing."""
    numbered = _as_2401(V.papers(spark, d).select("paper_id", "title"))
    a = _as_2401(V.authors(spark, d).withColumn("name", F.concat(F.lit("By "), "name")))
    number = F.substring_index("paper_id", ".", -1).cast("long").alias("paper_id")
    one = search.route("https://arxiv.org/abs/2401.00007v2", numbered, a).select(F.lit("id").alias("asked"), number, "title")
    named = search.route("by CUSTOMER#000000005", numbered, a).select(F.lit("name").alias("asked"), number, "title")
    return one.unionByName(named).unionByName(search.route("diffusion", numbered, a).select(F.lit("none").alias("asked"), number, "title"))


@query("SELECT p.paper_id, p.title, count(c.idx) AS n_chunks, (SELECT string_agg(name, '; ' ORDER BY position) FROM authors a WHERE a.paper_id = 7) AS authors FROM papers p LEFT JOIN chunks c ON c.paper_id = p.paper_id WHERE p.paper_id = 7 GROUP BY ALL")
def paper_lookup(spark, d):
    out = catalog.paper(V.papers(spark, d), V.chunks(spark, d), V.authors(spark, d), 7)
    return out.select("paper_id", "title", "n_chunks", F.array_join("authors", "; ").alias("authors"))


# -- statistics ------------------------------------------------------------------------------------


@query("SELECT paper_id, min(idx) AS idx FROM chunks WHERE contains(lower(section), 'intro') GROUP BY 1")
def intro_passages(spark, d):
    return catalog.intro(V.chunks(spark, d))


@query("SELECT min(p_type) AS name FROM part GROUP BY lower(p_type) HAVING count(*) = 1 UNION ALL SELECT min(n) FROM (SELECT c_name AS n FROM customer UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 2 = 0) GROUP BY lower(n) HAVING count(*) = 1", views=False)
def unambiguous_names(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_name").alias("name")).unionByName(c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("name")))
    return catalog.unambiguous_names(table(spark, d, "part").select(F.col("p_type").alias("name"))).unionByName(catalog.unambiguous_names(names))


@query(
    """
WITH d AS (SELECT event_id, value AS seconds, event_id % 3 AS k, event_type FROM events)
SELECT event_type AS kind, sum(k) ::BIGINT AS rejected, (SELECT count(*) FROM d) AS designs, (SELECT round(quantile_cont(seconds, 0.5), 6) FROM d) AS median_seconds, (SELECT sum(event_id % 4)::BIGINT FROM d) AS evidence_kept FROM d GROUP BY 1 HAVING sum(k) > 0
""",
    views=False,
)
def design_scorecard(spark, d):
    e = table(spark, d, "events")
    verdict = F.struct(F.col("event_type").alias("kind"))
    rows = e.select(F.col("event_id").alias("paper_id"), F.col("value").alias("seconds"), F.array_repeat(verdict, (F.col("event_id") % 3).cast("int")).alias("rejected"), (F.col("event_id") % 4).alias("evidence_kept"))
    return evaluate.scorecard(rows)


@query(
    """
WITH p AS (SELECT o_custkey AS category, o_orderkey % 2 AS cycle, o_orderdate, o_orderkey % 5 AS new, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)
SELECT cycle, category, count(*) * 5 AS fetched, sum(new)::BIGINT AS produced, (count(*) * 5 - sum(new))::BIGINT AS duplicates, min(o_orderdate) AS oldest_seen, bool_or(page >= 10 AND new > 0) AS capped FROM p GROUP BY ALL
""",
    views=False,
)
def poll_summary(spark, d):
    from pyspark.sql.window import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    polls = table(spark, d, "orders").select(F.col("o_custkey").alias("category"), (F.col("o_orderkey") % 2).alias("cycle"), F.lit(5).cast("long").alias("fetched"), (F.col("o_orderkey") % 5).alias("new"), F.col("o_orderdate").alias("oldest"), page.alias("page"), F.lit(10).alias("cap"))
    return evaluate.poll_summary(polls)


@query("SELECT user_id, round(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0), 3) AS rate FROM events GROUP BY 1", views=False)
def cache_rates(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return counts.select("user_id", cache.hit_rate(F.col("hits"), F.col("misses")).alias("rate"))


@query("SELECT web_id, count(DISTINCT paper_id) AS pending FROM reads WHERE paper_id % 3 <> 0 GROUP BY 1")
def pending_citations(spark, d):
    return recommend.pending(V.reads(spark, d), V.papers(spark, d).where("paper_id % 3 = 0"))


@query("SELECT count(*) AS messages, count(*) FILTER (doc_id % 10 <> 3) AS seen, count(*) = count(*) FILTER (doc_id % 10 <> 3) AS equal FROM documents", views=False)
def log_against_seen(spark, d):
    return audit.log_matches_seen(_docs(spark, d), _docs(spark, d).where("doc_id % 10 <> 3"))


# -- feeds and logs --------------------------------------------------------------------------------


def _escaped(c):
    return F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")


@query(
    r"""
SELECT '2401.' || lpad((c.c_custkey % 100000)::VARCHAR, 5, '0') AS arxiv_id, 1 + c.c_custkey % 4 AS version, c.c_name || ' & co' AS title, 'About ' || c.c_mktsegment AS abstract, c.c_name || '; Second Author' AS authors,
  CASE c.c_custkey % 3 WHEN 0 THEN 'cs.' || c.c_mktsegment ELSE 'cs.AI' END AS primary_category, CASE c.c_custkey % 3 WHEN 0 THEN 'cs.' || c.c_mktsegment || '; cs.AI' ELSE 'cs.AI' END AS categories,
  'https://arxiv.org/pdf/2401.' || lpad((c.c_custkey % 100000)::VARCHAR, 5, '0') || 'v' || (1 + c.c_custkey % 4) AS pdf_url, CASE WHEN c.c_custkey % 2 = 0 THEN '10.9/' || c.c_custkey END AS doi, '2024-01-02T03:04:05Z' AS published_at
FROM customer c WHERE c.c_custkey % 7 <> 0
""",
    views=False,
)
def atom_papers(spark, d):
    """Feeds of a customer each: one entry, a pseudo-entry, and a bad entry that is dropped."""
    key, version = F.lpad((F.col("c_custkey") % 100000).cast(STRING), 5, "0"), (1 + F.col("c_custkey") % 4).cast(STRING)
    term = F.concat(F.lit("cs."), F.col("c_mktsegment"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    third = F.col("c_custkey") % 3 == 0
    entry = F.concat(
        F.lit("<entry>"), tag("id", F.concat(F.lit("http://arxiv.org/abs/2401."), key, F.lit("v"), version)), F.lit("<published>2024-01-02T04:04:05+01:00</published><updated>2024-01-03T00:00:00Z</updated>"),
        tag("title", F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(_escaped(F.col("c_name")), F.lit("\n  &amp; co")))), tag("summary", F.concat(F.lit(" About "), _escaped(F.col("c_mktsegment")))),
        F.lit("<author><name>"), _escaped(F.col("c_name")), F.lit("</name></author><author><name>Second  Author</name></author>"),
        F.when(third, F.concat(F.lit('<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="'), term, F.lit('"/>'))).otherwise(F.lit("")), F.lit('<category term="cs.AI"/>'),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<link title="doi" href="http://dx.doi.org/10.9/'), _text("c_custkey"), F.lit('"/>'))).otherwise(F.lit("")),
        F.when(third, F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/2401.'), key, F.lit("v"), version, F.lit('"/>'))).otherwise(F.lit("")), F.lit("</entry>"),
    )
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/api/errors</id></entry>'), entry, F.lit("</feed>"))
    pages = table(spark, d, "customer").select(xml.alias("xml"), F.lit("2024-02-01T00:00:00Z").alias("polled_at"))
    out = feeds.papers_of_pages(pages)
    return longs(out, "version").select("arxiv_id", "version", "title", "abstract", F.array_join("authors", "; ").alias("authors"), "primary_category", F.array_join("categories", "; ").alias("categories"), "pdf_url", "doi", "published_at")


@query(
    """
SELECT '2402.' || lpad((s_suppkey % 100000)::VARCHAR, 5, '0') AS arxiv_id, 1 AS version, s_name AS title, 'F. ' || s_name AS authors, CASE s_nationkey % 2 WHEN 0 THEN 'cs.LG' ELSE 'math.GT' END AS primary_category
FROM supplier WHERE s_suppkey % 5 <> 0 AND s_nationkey % 2 = 0
""",
    views=False,
)
def harvest_papers(spark, d):
    """Bulk-harvest responses of a supplier each, of wanted categories; records without a title are left out."""
    field = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    name = _escaped(F.col("s_name"))
    meta = F.concat(
        field("id", F.concat(F.lit("2402."), F.lpad((F.col("s_suppkey") % 100000).cast(STRING), 5, "0"))), F.lit("<created>2024-01-05</created><authors><author>"), field("keyname", name), F.lit("<forenames>F.</forenames></author></authors>"),
        field("title", F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(name)), field("categories", F.when(F.col("s_nationkey") % 2 == 0, F.lit("cs.LG stat.ML")).otherwise(F.lit("math.GT"))), F.lit("<abstract>Some text</abstract>"),
    )
    xml = F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/">'), meta, F.lit("</arXiv></metadata></record></ListRecords></OAI-PMH>"))
    pages = table(spark, d, "supplier").select(xml.alias("xml"), F.lit("2024-02-01T00:00:00Z").alias("polled_at"))
    out = feeds.in_categories(feeds.papers_of_pages(pages, "harvest"), ["stat.ML", "hep-th"])
    return longs(out, "version").select("arxiv_id", "version", "title", F.array_join("authors", "; ").alias("authors"), "primary_category")


@query("SELECT paper_id::VARCHAR AS arxiv_id, version, paper_id::VARCHAR || 'v' || version AS member FROM papers WHERE paper_id % 4 <> 0 OR version = 1")
def unseen_papers(spark, d):
    own = V.papers(spark, d).select(_text("paper_id").alias("arxiv_id"), "version")
    seen = own.where("cast(arxiv_id as long) % 4 = 0 and version <> 1").select(T.versioned_id(F.col("arxiv_id"), F.col("version")).alias("member"))
    return feeds.unseen(own, seen.unionByName(seen))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY ALL", views=False)
def versions_seen(spark, d):
    """Each key once, by the streams' operator over a bounded log; of a key any event may be the one that stays, so its least is asked."""
    own = table(spark, d, "events").where("event_type <> 'error'")
    least = dedup.earliest(own, ("user_id", "event_type"), "event_id")
    kept = dedup.first_versions(own, ("user_id", "event_type")).select("user_id", "event_type")
    return kept.join(least, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY event_id) - 1 AS nth FROM (SELECT user_id::VARCHAR AS key, event_type || event_id AS value, event_id FROM events)", views=False)
def log_offsets(spark, d):
    """Messages of a key stand in one partition in their order of arrival."""
    from pyspark.sql.window import Window

    messages = table(spark, d, "events").select(_text("user_id").alias("key"), F.concat("event_type", _text("event_id")).alias("value"), F.col("event_id").alias("arrival"))
    rows = log.records(messages, "t", F.lit(NOW))
    order = Window.partitionBy("key", "partition").orderBy("offset")
    return rows.withColumn("nth", F.row_number().over(order).cast("long") - 1).select("key", "value", "nth")


@query(
    """
SELECT doc_id AS paper_id, 'worker' AS stage, left(text, 2000) AS error, greatest(1, doc_id % 4) AS attempts, '{"id":' || doc_id || '}' AS payload FROM documents
""",
    views=False,
)
def dead_letters(spark, d):
    failed = _docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("text").alias("error"), (F.col("doc_id") % 4).alias("attempts"), F.concat(F.lit('{"id":'), _text("doc_id"), F.lit("}")).alias("payload"))
    return dlq.dead_letter(failed, "worker", F.lit(NOW)).select("paper_id", "stage", "error", "attempts", "payload")


# -- citations -------------------------------------------------------------------------------------


@query(
    """
SELECT o_orderkey AS paper_id, direction, k AS position, CASE (o_orderkey + k) % 4 WHEN 0 THEN 'arxiv:2401.' || (10000 + k) WHEN 1 THEN 's2:p' || k WHEN 2 THEN 'title:title ' || k END AS other_key,
  CASE (o_orderkey + k) % 4 WHEN 0 THEN '2401.' || (10000 + k) END AS other_id FROM orders, (VALUES ('cites', 7), ('cited_by', 4)) AS n(direction, most), (SELECT unnest(range(0, 7)) AS k) WHERE k < least(most, 5) AND (o_orderkey + k) % 4 <> 3
""",
    views=False,
)
def citation_edges(spark, d):
    """Citation records of an order each, read with a cap of five a direction."""
    null = F.lit(None).cast(STRING)

    def others(n):
        def one(k):
            kind, number = (F.col("o_orderkey") + k) % 4, k.cast(STRING)
            own = F.struct(F.when(kind == 0, F.concat(F.lit("2401."), (k + 10000).cast(STRING), F.lit("v3"))).alias("ArXiv"))
            return F.struct(F.when(kind == 1, F.concat(F.lit("p"), number)).alias("paperId"), F.when(kind == 2, F.concat(F.lit("Title, "), number)).otherwise(null).alias("title"), F.lit(2020).alias("year"), own.alias("externalIds"))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)

    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.to_json(F.struct(others(7).alias("references"), others(4).alias("citations"))).alias("record"))
    return citations.from_records(records, cap=5).select("paper_id", "direction", F.col("position").cast("long").alias("position"), "other_key", "other_id")


@query(
    """
, f AS (SELECT paper_id, paper_id % 2 = 0 AS api_ok, ['ok', 'none', 'failed'][1 + paper_id % 3] AS html FROM papers WHERE paper_id % 11 <> 0),
e AS (SELECT paper_id, count(*) AS n, count(*) FILTER (direction = 'cites' AND position = 2) AS refs FROM citations WHERE paper_id % 5 <> 1 GROUP BY 1)
SELECT paper_id, CASE WHEN coalesce(refs, 0) > 0 THEN 'done' WHEN html = 'failed' THEN 'failed' WHEN NOT api_ok THEN 'partial' WHEN coalesce(n, 0) > 0 THEN 'done' ELSE 'missing' END AS status FROM f LEFT JOIN e USING (paper_id)
"""
)
def citation_status(spark, d):
    p = V.papers(spark, d).select("paper_id").where("paper_id % 11 <> 0")
    fetched = p.select("paper_id", (F.col("paper_id") % 2 == 0).alias("api_ok"), F.element_at(F.array(F.lit("ok"), F.lit("none"), F.lit("failed")), (1 + F.col("paper_id") % 3).cast("int")).alias("html"))
    edges = V.citations(spark, d).where("paper_id % 5 <> 1").withColumn("via", F.when(F.col("position") == 2, "api").otherwise("html"))
    return citations.status(V.papers(spark, d), edges, fetched)


@query("SELECT paper_id FROM papers WHERE paper_id % 4 >= 2 OR ingested_at > TIMESTAMP '2024-01-31 00:00:00'")
def citation_cache(spark, d):
    status = F.element_at(F.array(F.lit("failed"), F.lit("partial"), F.lit("done"), F.lit("missing")), (1 + F.col("paper_id") % 4).cast("int"))
    return citations.fresh(V.papers(spark, d).select("paper_id", status.alias("status"), F.col("ingested_at").alias("fetched_at")), F.lit(NOW))


@query(
    """
, new AS (SELECT paper_id, direction, other_key, position FROM citations WHERE paper_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY paper_id, direction, other_key ORDER BY position) = 1)
SELECT paper_id, direction, other_key, position + 10 AS position FROM citations WHERE paper_id NOT IN (SELECT paper_id FROM new) AND paper_id % 3 <> 0 UNION ALL SELECT * FROM new
"""
)
def citation_store(spark, d):
    c = V.citations(spark, d).select("paper_id", "direction", "other_key", F.col("position").cast("long").alias("position"))
    return citations.store(c.where("paper_id % 3 <> 0").withColumn("position", F.col("position") + 10), c.where("paper_id % 2 = 0").unionByName(c.where("paper_id % 2 = 0").withColumn("position", F.col("position") + 5)))


# -- table edits -----------------------------------------------------------------------------------


@query("SELECT paper_id, idx, section FROM chunks WHERE paper_id % 3 <> 0 UNION ALL SELECT paper_id, idx + 1, 'new' FROM chunks WHERE paper_id % 3 = 0 AND idx < 2")
def chunk_replace(spark, d):
    c = V.chunks(spark, d).select("paper_id", "idx", "section")
    return merge.replace_by_paper(c, c.where("paper_id % 3 = 0 and idx < 2").withColumns({"idx": F.col("idx") + 1, "section": F.lit("new")}))


@query(
    """
, old AS (SELECT paper_id, version, 1 AS parser, 'old' AS figures FROM papers WHERE paper_id % 3 <> 0), new AS (SELECT paper_id, 1 + paper_id % 4 AS version, 1 + paper_id % 2 AS parser, 'new' AS figures FROM papers WHERE paper_id % 2 = 0)
SELECT * FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY version DESC, parser DESC, n DESC) = 1
""".replace("SELECT * FROM (SELECT *, 0", "SELECT paper_id, version, parser, figures FROM (SELECT *, 0")
)
def figures_latest(spark, d):
    p = V.papers(spark, d)
    old = p.where("paper_id % 3 <> 0").select("paper_id", F.col("version").cast("long").alias("version"), F.lit(1).cast("long").alias("parser"), F.lit("old").alias("figures"))
    new = p.where("paper_id % 2 = 0").select("paper_id", (1 + F.col("paper_id") % 4).alias("version"), (1 + F.col("paper_id") % 2).alias("parser"), F.lit("new").alias("figures"))
    return merge.latest_wins(old, new, ["paper_id"], ["version", "parser"])


@query("SELECT web_id, paper_id, 0 AS late FROM reads WHERE paper_id % 2 = 0 UNION ALL SELECT DISTINCT web_id, paper_id, 1 FROM reads WHERE paper_id % 2 = 1")
def trail_insert(spark, d):
    own = V.reads(spark, d).select("web_id", "paper_id")
    return trail.insert_ignore(own.where("paper_id % 2 = 0").withColumn("late", F.lit(0).cast("long")), own.unionByName(own).withColumn("late", F.lit(1).cast("long")), ["web_id", "paper_id"])


@query(
    """
, t AS (SELECT paper_id, min(web_id) AS web_id FROM reads GROUP BY 1), m AS (SELECT paper_id, CASE WHEN paper_id = 8 THEN 999 ELSE web_id END AS web_id FROM t), l AS (SELECT * FROM m WHERE web_id <> 5 AND paper_id <> 9),
w AS (SELECT DISTINCT web_id FROM t)
SELECT 'trail' AS part, paper_id, web_id, NULL AS name FROM l
UNION ALL SELECT 'webs', NULL, web_id, CASE web_id WHEN 3 THEN 'renamed' ELSE 'web ' || web_id END FROM w WHERE web_id <> 5 AND NOT (web_id IN (SELECT web_id FROM m WHERE paper_id = 9) AND web_id NOT IN (SELECT web_id FROM l))
"""
)
def trail_edits(spark, d):
    """A web renamed, a paper moved, a web deleted, a paper removed (and its web, if it was the last)."""
    own = V.reads(spark, d).groupBy("paper_id").agg(F.min("web_id").alias("web_id"))
    webs = own.select("web_id").distinct().withColumn("name", F.concat(F.lit("web "), _text("web_id")))
    webs, own = trail.rename(webs, 3, "renamed"), trail.move(own, 8, 999)
    own, webs = trail.delete_web(own, webs, 5)
    own, webs = trail.remove(own, webs, 9)
    left = own.select(F.lit("trail").alias("part"), "paper_id", "web_id", F.lit(None).cast(STRING).alias("name"))
    return left.unionByName(webs.select(F.lit("webs").alias("part"), F.lit(None).cast("long").alias("paper_id"), "web_id", "name"))


@query(
    """
, w AS (SELECT paper_id AS query_id, title AS name, CASE WHEN paper_id % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE ingested_at END AS seen_at, categories FROM papers WHERE paper_id <> 6)
SELECT query_id, name, seen_at, array_to_string(categories, ';') AS categories FROM w UNION ALL SELECT 1000000, 'asked text', TIMESTAMP '2024-02-01', NULL
"""
)
def watch_edits(spark, d):
    """One watch deleted, some marked as seen, one created with the default name and an empty list of categories."""
    p = V.papers(spark, d)
    watches = p.select(F.col("paper_id").alias("query_id"), F.col("title").alias("name"), F.col("title").alias("text"), "categories", F.lit(None).cast("array<double>").alias("vector"), F.col("ingested_at").alias("created_at"), F.col("ingested_at").alias("seen_at"))
    watches = watch.mark_seen(watch.delete(watches, 6), watches.where("query_id % 4 = 0"), F.lit(NOW))
    out = watch.create(watches, 1_000_000, "asked text", [0.0], F.lit(NOW), categories=[])
    return out.select("query_id", "name", "seen_at", F.array_join("categories", ";").alias("categories"))


@query(
    """
SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS cost, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS finished_at FROM orders
""",
    views=False,
)
def job_finish(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("paper_id"), F.lit("p").alias("provider"), F.lit("running").alias("status"))
    results = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("paper_id"), F.lit("p").alias("provider"), F.lit("done").alias("new_status"), F.col("o_totalprice").alias("cost"))
    return merge.finish(jobs, results, F.lit(NOW)).select("paper_id", "status", "cost", "finished_at")


@query(
    """
, t AS (SELECT paper_id, min(web_id) AS web_id FROM reads WHERE paper_id % 2 = 0 GROUP BY 1),
r AS (SELECT event_id, paper_id, user_id, ts, event_type FROM (SELECT event_id, event_id % (SELECT greatest(1, count(*)) FROM documents) AS paper_id, user_id, ts, event_type FROM events WHERE event_type IN ('view', 'click')) WHERE paper_id NOT IN (SELECT paper_id FROM t)
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ts, event_id) = 1)
SELECT paper_id, CASE WHEN user_id IN (SELECT web_id FROM t) THEN user_id END AS web_id, CASE event_type WHEN 'view' THEN 'manual' ELSE 'search' END AS kind FROM r
"""
)
def recorded_reads(spark, d):
    """New reads of a batch: the first of each paper, in the hinted web if it exists, else in a new one (null here, as its number is made)."""
    own = V.reads(spark, d).where("paper_id % 2 = 0").groupBy("paper_id").agg(F.min("web_id").alias("web_id")).withColumns({"added_at": F.lit(NOW), "via": F.lit(None).cast("long"), "kind": F.lit("manual"), "query": F.lit(None).cast(STRING)})
    webs = own.select("web_id").distinct().withColumns({"name": F.lit("w"), "created_at": F.lit(NOW)})
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    reads = e.select(F.col("event_id").alias("read_id"), (F.col("event_id") % V.n_papers(spark, d)).alias("paper_id"), F.lit(None).cast("long").alias("via"), F.when(F.col("event_type") == "view", "manual").otherwise("other").alias("kind"), F.lit("asked").alias("query"), F.col("user_id").alias("web_hint"), F.col("ts").cast("timestamp").alias("at"))
    none = V.chunks(spark, d).where("false")
    after, _ = trail.record_reads(reads, own, webs, none, V.papers(spark, d))
    old = webs.select(F.col("web_id").alias("old"))
    new = after.join(own.select("paper_id"), "paper_id", "left_anti")
    return new.join(old, new.web_id == old.old, "left").select("paper_id", F.col("old").alias("web_id"), "kind")


# -- suggestions -----------------------------------------------------------------------------------


@query(
    ", "
    + _REASONS.strip()
    + """,
cand AS (SELECT web_id, key, max(other_id) AS other_id, round(sum(weight) + 1e-10, 6) AS score, arg_min(source, (-round(weight, 3), kind, source)) AS source FROM reasons GROUP BY web_id, key),
free AS (SELECT * FROM cand WHERE key NOT IN (SELECT 'arxiv:' || paper_id FROM reads) AND (other_id IS NULL OR other_id NOT IN (SELECT paper_id FROM reads))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY web_id ORDER BY score DESC, key) AS n FROM free),
caps AS (SELECT web_id, greatest(4, ceil(12.0 / greatest(1, count(DISTINCT source))))::BIGINT AS cap, count(*) AS n_all FROM free GROUP BY 1),
fold AS (
  SELECT web_id, 0::BIGINT AS n, []::BIGINT[] AS chosen, []::BIGINT[] AS sources, 0::BIGINT AS outside FROM caps
  UNION ALL
  SELECT f.web_id, f.n + 1, CASE WHEN full_ THEN chosen ELSE list_append(chosen, o.n) END, CASE WHEN full_ THEN sources ELSE list_append(sources, o.source) END, outside + (NOT full_ AND o.other_id IS NULL)::BIGINT
  FROM fold f JOIN caps USING (web_id) JOIN ordered o ON o.web_id = f.web_id AND o.n = f.n + 1,
    LATERAL (SELECT len(chosen) >= 12 OR len(list_filter(sources, lambda s: s = o.source)) >= cap OR (o.other_id IS NULL AND outside >= 4) AS full_)),
last AS (SELECT web_id, chosen FROM fold JOIN caps USING (web_id) WHERE n = n_all),
picked AS (SELECT web_id, place, chosen[place] AS n FROM (SELECT web_id, chosen, unnest(range(1, len(chosen) + 1)) AS place FROM last))
SELECT p.web_id, p.place, o.key, o.other_id, o.score, o.source, round(sqrt(o.score / max(o.score) OVER (PARTITION BY p.web_id)), 6) AS strength FROM picked p JOIN ordered o ON o.web_id = p.web_id AND o.n = p.n
"""
)
def suggestions_picked(spark, d):
    own = V.reads(spark, d)
    found = recommend.reasons(own, V.citations(spark, d), V.chunks(spark, d))
    return longs(recommend.strength(recommend.pick(recommend.without(recommend.scored(found), own))), "place")
