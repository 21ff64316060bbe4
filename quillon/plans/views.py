"""Paper-shaped views over the fixture tables, declared alike for Spark and (as SQL) for DuckDB.

papers: documents as papers. chunks: embeddings as four passages a paper. authors: three customers a paper. reads: view events
as papers added to a user's web. citations: four edges a paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import graphindex, keyword
from quillon.operators.stored import stored
from quillon.shared import table

SECTIONS = ("abstract", "1 Introduction", "2 Method", "3 Results")

def n_papers(spark: SparkSession, d: str) -> int:
    """Papers that reads, citations and dead letters refer to by number: all."""
    return max(1, table(spark, d, "documents").count())


def papers(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r]+", 10), lambda w: w != "")  # eight words, perhaps a blank before, and the rest
    hours = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("paper_id"),
        (1 + F.col("doc_id") % 3).alias("version"),
        F.array_join(F.slice(words, 1, 8), " ").alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("primary_category"),
        F.array("lang", "source").alias("categories"),
        hours.alias("published_at"),
        (hours + F.expr("INTERVAL 1 DAY")).alias("ingested_at"),
        F.element_at(F.array(F.lit("html"), F.lit("pdf"), F.lit("abstract")), (1 + F.col("doc_id") % 3).cast("int")).alias("source"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    idx = F.col("vec_id") % 4
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 4").alias("paper_id"), idx.alias("idx"), F.element_at(F.array(*map(F.lit, SECTIONS)), (idx + 1).cast("int")).alias("section"), "embedding"
    )


def postings(spark: SparkSession, d: str) -> DataFrame:
    """Exact postings of the papers, stored."""
    return stored("exact-postings", table(spark, d, "documents"), lambda: keyword.write_order(keyword.exact_postings(papers(spark, d))))


def position_postings(spark: SparkSession, d: str, lexer: str = keyword.ENGLISH) -> DataFrame:
    """Postings with positions, stored."""
    return stored(f"{lexer}-positions-{keyword.VERSION}", table(spark, d, "documents"), lambda: keyword.write_order(keyword.position_postings(papers(spark, d), lexer)))


def index(spark: SparkSession, d: str) -> graphindex.GraphIndex:
    """The graph index of all passages with the attributes that searches filter by, stored."""
    rows = chunks(spark, d).join(papers(spark, d).select("paper_id", "categories", "published_at"), "paper_id", "left")
    sources = [table(spark, d, "embeddings"), table(spark, d, "documents")]
    return graphindex.GraphIndex(stored(f"graph-index-{graphindex.VERSION}", sources, lambda: graphindex.build(rows, attributes=("categories", "published_at"))))


def authors(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, position, name)."""
    positions = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("position"))
    keyed = positions.withColumn("key", (F.col("paper_id") * F.col("position")) % 97 + 1)
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return keyed.join(names, "key").select("paper_id", "position", "name")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(web_id, paper_id, added_at, event_id): the first view of a paper by a user."""
    views = table(spark, d, "events").where("event_type = 'view'")
    return views.groupBy(F.col("user_id").alias("web_id"), (F.col("event_id") % n_papers(spark, d)).alias("paper_id")).agg(F.min("event_id").alias("event_id"), F.min("ts").cast("timestamp").alias("added_at"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, direction, other_key, other_id, position)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("position"))
    other = (F.col("paper_id") * 7 + F.col("position") * 13) % n_papers(spark, d)
    outside = (F.col("paper_id") + F.col("position")) % 5 == 0
    edges = docs.select(
        "paper_id",
        F.when(F.col("position") % 2 == 0, "cites").otherwise("cited_by").alias("direction"),
        F.when(outside, F.concat(F.lit("s2:"), other.cast("string"))).otherwise(F.concat(F.lit("arxiv:"), other.cast("string"))).alias("other_key"),
        F.when(~outside, other).alias("other_id"),
        "position",
    )
    return edges.where(F.col("other_id").isNull() | (F.col("other_id") != F.col("paper_id")))


N_PAPERS = "(SELECT greatest(1, count(*)) FROM documents)"
SQL = rf"""
papers AS (
  SELECT doc_id AS paper_id, 1 + doc_id % 3 AS version, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')[1:8], ' ') AS title,
    text AS abstract, lang AS primary_category, [lang, source] AS categories, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS published_at,
    TIMESTAMP '2024-01-02' + to_hours(doc_id::INT) AS ingested_at, ['html', 'pdf', 'abstract'][1 + doc_id % 3] AS source FROM documents),
chunks AS (SELECT vec_id // 4 AS paper_id, vec_id % 4 AS idx, {list(SECTIONS)!r}[1 + vec_id % 4] AS section, embedding FROM embeddings),
authors AS (
  SELECT p.paper_id, p.position, c.c_name AS name FROM (SELECT doc_id AS paper_id, unnest([1, 2, 3]) AS position FROM documents) p
  JOIN customer c ON c.c_custkey = (p.paper_id * p.position) % 97 + 1),
reads AS (
  SELECT user_id AS web_id, event_id % {N_PAPERS} AS paper_id, min(event_id) AS event_id, min(ts) AS added_at FROM events WHERE event_type = 'view' GROUP BY ALL),
citations AS (
  SELECT * FROM (
    SELECT paper_id, CASE WHEN position % 2 = 0 THEN 'cites' ELSE 'cited_by' END AS direction,
      CASE WHEN (paper_id + position) % 5 = 0 THEN 's2:' ELSE 'arxiv:' END || ((paper_id * 7 + position * 13) % {N_PAPERS}) AS other_key,
      CASE WHEN (paper_id + position) % 5 <> 0 THEN (paper_id * 7 + position * 13) % {N_PAPERS} END AS other_id, position
    FROM (SELECT doc_id AS paper_id, unnest([1, 2, 3, 4]) AS position FROM documents)) WHERE other_id IS NULL OR other_id <> paper_id)
"""


def sql(body: str) -> str:
    """Oracle SQL over the views; body goes on after the view definitions (', x AS (...) SELECT' or 'SELECT')."""
    return f"WITH {'RECURSIVE ' if 'fold AS' in body else ''}{SQL.strip()}\n{body.strip()}"
