"""Search: filtered dense candidates, best passage a paper, keyword candidates, and reciprocal-rank fusion.

Every step carries a query_id, so one plan answers a batch of queries. Wide columns are joined after the last limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.graphindex import GraphIndex
from quillon.operators.keyword import exact_search
from quillon.operators.vectors import DIGITS, best_per_paper, cosine, top_matches
from quillon.shared import cut

CANDIDATES, RRF_K, K = 200, 60, 10
#: Named windows, in days.
WINDOWS = {"day": 1, "week": 7, "month": 30, "year": 365}


@dataclass(frozen=True)
class Filters:
    """None or an empty list of categories means no filter; since is inclusive."""

    categories: Sequence[str] | None = None
    since: datetime | None = None

    def apply(self, papers: DataFrame) -> DataFrame:
        if self.categories:
            papers = papers.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in self.categories])))
        return papers.where(F.col("published_at") >= F.lit(self.since)) if self.since else papers

    def allow(self, attribute: Column) -> Column:
        """The same over an index's attributes (categories, published_at); a passage without a paper has neither."""
        own = attribute["published_at"].isNotNull()
        if self.categories:
            own = own & F.arrays_overlap(attribute["categories"], F.array(*[F.lit(c) for c in self.categories]))
        return own & (attribute["published_at"] >= F.lit(self.since)) if self.since else own


def since_for(window: str | None, now: datetime) -> datetime | None:
    return now - timedelta(days=WINDOWS[window]) if window in WINDOWS else None


def check_request(query: str, k: int) -> None:
    if not 1 <= len(query) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")


def candidates(queries: DataFrame, chunks: DataFrame, papers: DataFrame, filters: Filters | None = None, n: int = CANDIDATES, index: GraphIndex | None = None) -> DataFrame:
    """The n nearest passages of papers that pass the filters; filters come first. With an index (of passages with their papers'
    categories and published_at) they are those that its walks find."""
    if index:
        return index.search(queries, n, (filters or Filters()).allow)
    allowed = (filters or Filters()).apply(papers).select("paper_id")
    return top_matches(queries, chunks.join(allowed, "paper_id", "left_semi"), n)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(queries: DataFrame, chunks: DataFrame, papers: DataFrame, k: int = K, filters: Filters | None = None, n: int = CANDIDATES, index: GraphIndex | None = None) -> DataFrame:
    """(query_id, paper_id, idx, score, rank): each query's k best papers by their best passage."""
    return _ranked(best_per_paper(candidates(queries, chunks, papers, filters, n, index)), k)


def fuse(dense_list: DataFrame, keyword_list: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, paper_id, idx, score, rank) and (query_id, paper_id, krank)."""
    both = dense_list.join(keyword_list.select("query_id", "paper_id", "krank"), ["query_id", "paper_id"], "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", F.round(part("rank") + part("krank"), 9)).withColumn("keyword", F.col("krank").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "paper_id")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def hybrid(queries: DataFrame, texts: DataFrame, chunks: DataFrame, papers: DataFrame, k: int = K, filters: Filters | None = None, n: int = CANDIDATES, postings: DataFrame | None = None, index: GraphIndex | None = None) -> DataFrame:
    """(query_id, position, paper_id, idx, score, rrf, keyword). A paper found by keyword alone shows its first passage, with
    that passage's cosine. queries: (query_id, vector); texts: (query_id, text)."""
    allowed = (filters or Filters()).apply(papers)
    every = best_per_paper(candidates(queries, chunks, papers, filters, n, index))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    dense_list = every.withColumn("rank", F.row_number().over(order))
    keyword_list = exact_search(texts, postings, allowed)  # postings of other papers fall out as they meet the allowed ones
    fused = fuse(dense_list, keyword_list, k)
    fused = cut(fused)  # at most k rows a query
    lone = fused.where("score is null")
    first = chunks.where("idx = 0").join(lone.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", F.col("embedding").alias("first"))
    shown = lone.join(first, "paper_id", "left").join(queries, "query_id", "left")
    shown = shown.withColumn("score", F.round(cosine(F.col("first"), F.col("vector")), DIGITS)).withColumn("idx", F.when(F.col("first").isNotNull(), F.lit(0)))
    out = fused.where("score is not null").unionByName(shown.select(*fused.columns))
    idx, score = F.col("idx"), F.col("score")
    return out.select("query_id", F.col("position").cast("long").alias("position"), "paper_id", idx.cast("long").alias("idx"), score.alias("score"), "rrf", "keyword")


def answer(queries: DataFrame, texts: DataFrame | None, chunks: DataFrame, papers: DataFrame, k: int = K, filters: Filters | None = None, keyword: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, position, paper_id, idx, score, rrf, keyword): hybrid, or dense alone without texts or with the keyword side off."""
    if keyword and texts is not None:
        return hybrid(queries, texts, chunks, papers, k, filters, postings=postings)
    found = dense(queries, chunks, papers, k, filters)
    return found.select("query_id", F.col("rank").cast("long").alias("position"), "paper_id", "idx", "score", F.lit(None).cast("double").alias("rrf"), F.lit(False).alias("keyword"))


def hits(found: DataFrame, papers: DataFrame, authors: DataFrame, base_url: str = "https://arxiv.org/abs/") -> DataFrame:
    """Wide rows of found papers: title, authors in order, rounded score, link. Joined after the limits."""
    names = author_lists(authors)
    wide = found.join(papers.select("paper_id", "title", "abstract", "primary_category", "published_at", "version"), "paper_id").join(names, "paper_id", "left")
    return wide.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))).withColumn("score", F.round("score", 4)).withColumn("url", F.concat(F.lit(base_url), F.col("paper_id").cast("string")))


def author_lists(authors: DataFrame) -> DataFrame:
    """(paper_id, authors): names in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("position", "name")))
    return authors.groupBy("paper_id").agg(F.transform(rows, lambda x: x["name"]).alias("authors"))


def similar(paper_id: int | DataFrame, chunks: DataFrame, papers: DataFrame, k: int = K) -> DataFrame:
    """Papers like one, or like each of a table of paper_id: its first passage as the query over all passages, itself dropped after asking for one more."""
    first = chunks.where("idx = 0")
    own = first.join(paper_id.select("paper_id").distinct(), "paper_id", "left_semi") if isinstance(paper_id, DataFrame) else first.where(F.col("paper_id") == paper_id)
    query = own.select(F.col("paper_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = dense(query, chunks, papers, k + 1).where("paper_id <> query_id")
    return _ranked(found.drop("rank"), k)


def route(query: str, papers: DataFrame, authors: DataFrame) -> Column | DataFrame:
    """A query that is an id or a link answers with that paper; one of 2 to 4 words that is an author's name with their papers."""
    from quillon.functions.text import author_norm, parse_paper_id

    asked = papers.sparkSession.range(1).select(parse_paper_id(F.lit(query)).alias("id"))
    by_id = papers.join(asked, papers.paper_id.cast("string") == asked.id).select(papers["*"])
    if not 2 <= len(query.split()) <= 4:
        return by_id
    named = authors.where(author_norm("name") == author_norm(F.lit(query))).select("paper_id").distinct()
    return by_id.unionByName(papers.join(named, "paper_id", "left_semi")).dropDuplicates(["paper_id"])
