"""Standing queries: matches of saved searches with a relevance floor, new since the last visit first, and their feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.search import Filters, hybrid

FLOOR, LIMIT = 0.55, 50


def matches(watches: DataFrame, found: DataFrame, papers: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(query_id, place, paper_id, score, keyword, is_new) from search results (query_id, position, paper_id, score, keyword).

    A hit stays if the keyword side found it or its score reaches the floor. New is ingested strictly after seen_at; new
    hits come first and relevance order is kept within both parts."""
    rows = found.where(F.col("keyword") | (F.col("score") >= floor)).join(papers.select("paper_id", "ingested_at"), "paper_id", "left").join(watches.select("query_id", "seen_at"), "query_id")
    rows = rows.withColumn("is_new", F.coalesce("ingested_at", "seen_at") > F.col("seen_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("is_new"), "position")
    return rows.select("query_id", F.row_number().over(order).cast("long").alias("place"), "paper_id", "score", "keyword", "is_new")


def run(watches: DataFrame, chunks: DataFrame, papers: DataFrame, k: int = LIMIT, filters: Filters | None = None, floor: float = FLOOR, postings: DataFrame | None = None) -> DataFrame:
    """All watches (query_id, text, vector, seen_at) in one plan."""
    found = hybrid(watches.select("query_id", "vector"), watches.select("query_id", "text"), chunks, papers, k, filters, postings=postings)
    return matches(watches, found, papers, floor)


def mark_seen(watches: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """The watch table after a visit of the watches in seen; matches are computed before."""
    own = seen.select("query_id").distinct().withColumn("visited", F.lit(True))
    return watches.join(own, "query_id", "left").withColumn("seen_at", F.when(F.col("visited"), now).otherwise(F.col("seen_at"))).drop("visited")


def create(watches: DataFrame, query_id: int, text: str, vector: list[float], now: Column, name: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """The table with one watch more: its name defaults to the query, empty categories to none."""
    row = watches.sparkSession.createDataFrame([(query_id, name or text, text, list(categories) if categories else None, [float(x) for x in vector])], "query_id long, name string, text string, categories array<string>, vector array<double>")
    return watches.unionByName(row.withColumn("created_at", now).withColumn("seen_at", now), allowMissingColumns=True)


def delete(watches: DataFrame, query_id: int) -> DataFrame:
    return watches.where(F.col("query_id") != query_id)


def feed(matched: DataFrame, watches: DataFrame, papers: DataFrame, authors: DataFrame) -> DataFrame:
    """Atom entries of each watch, newest first: at most 10 authors, the summary or else the abstract; feed_updated is the newest
    hit's time or the watch's creation."""
    from quillon.operators.search import author_lists

    has_summary = "summary" in papers.columns
    text = F.coalesce("summary", "abstract") if has_summary else F.col("abstract")
    wide = matched.join(papers, "paper_id").join(author_lists(authors), "paper_id", "left").withColumn("content", text)
    newest = Window.partitionBy("query_id")
    wide = wide.join(watches.select("query_id", "created_at"), "query_id").withColumn("feed_updated", F.coalesce(F.max("published_at").over(newest), "created_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("published_at"), F.desc("paper_id"))
    return wide.select("query_id", F.row_number().over(order).alias("entry"), "paper_id", "title", F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 10).alias("authors"), "content", "published_at", "feed_updated")


def to_atom(entries: DataFrame) -> DataFrame:
    """One XML document a watch."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), esc(a), F.lit("</name></author>"))), "")
    entry = F.concat(F.lit("<entry><id>"), F.col("paper_id").cast("string"), F.lit("</id><title>"), esc(F.col("title")), F.lit("</title><updated>"), when(F.col("published_at")), F.lit("</updated>"), people, F.lit("<summary>"), esc(F.col("content")), F.lit("</summary></entry>"))
    rows = F.array_sort(F.collect_list(F.struct("entry", entry.alias("xml"))))
    body = F.array_join(F.transform(rows, lambda r: r["xml"]), "")
    return entries.groupBy("query_id").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><updated>'), when(F.max("feed_updated")), F.lit("</updated>"), body, F.lit("</feed>")).alias("xml"))
