"""Listings and statistics over the paper tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import author_norm
from quillon.operators.search import author_lists

PAGE = 30


def latest(papers: DataFrame, limit: int = PAGE, offset: int = 0, categories: list[str] | None = None) -> DataFrame:
    """A page of the newest papers; has_next tells whether a further one exists (one row more is read)."""
    if categories:
        papers = papers.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    rows = papers.select("paper_id", "title", "primary_category", "published_at").orderBy(F.desc("published_at"), F.desc("paper_id")).offset(offset).limit(limit + 1)
    more = rows.agg((F.count("*") > limit).alias("has_next"))
    return rows.limit(limit).crossJoin(F.broadcast(more))  # more is one row


def paper(papers: DataFrame, chunks: DataFrame, authors: DataFrame, paper_id: int) -> DataFrame:
    """One paper with its authors and its number of passages."""
    one = papers.where(F.col("paper_id") == paper_id)
    n = chunks.where(F.col("paper_id") == paper_id).groupBy("paper_id").agg(F.count("*").alias("n_chunks"))
    out = one.join(author_lists(authors.where(F.col("paper_id") == paper_id)), "paper_id", "left").join(n, "paper_id", "left")
    return out.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def brief(papers: DataFrame, authors: DataFrame, ids: DataFrame) -> DataFrame:
    """The brief columns of the papers in ids."""
    own = papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "title", "primary_category", "published_at")
    return own.join(author_lists(authors), "paper_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def author_counts(authors: DataFrame) -> DataFrame:
    """(name_norm, name, papers): an author's papers under the normalised name; the least spelling is shown."""
    return authors.groupBy(author_norm("name").alias("name_norm")).agg(F.min("name").alias("name"), F.countDistinct("paper_id").alias("papers"))


def author_papers(authors: DataFrame, papers: DataFrame, name: str, limit: int = 100) -> DataFrame:
    own = authors.where(author_norm("name") == author_norm(F.lit(name))).select("paper_id").distinct()
    return papers.join(own, "paper_id", "left_semi").select("paper_id", "title", "published_at").orderBy(F.desc("published_at"), F.desc("paper_id")).limit(limit)


def unambiguous_names(names: DataFrame) -> DataFrame:
    """Names that occur once when case is folded."""
    return names.groupBy(F.lower("name").alias("folded")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").select("name")


def sections(chunks: DataFrame) -> DataFrame:
    """Each paper's sections behind the abstract in document order: (paper_id, section, first_idx)."""
    return chunks.where("idx > 0 and section is not null").groupBy("paper_id", "section").agg(F.min("idx").alias("first_idx"))


def intro(chunks: DataFrame) -> DataFrame:
    """The first passage of each paper whose section speaks of an introduction."""
    return chunks.where(F.lower("section").contains("intro")).groupBy("paper_id").agg(F.min("idx").alias("idx"))


def totals(papers: DataFrame, chunks: DataFrame, authors: DataFrame) -> DataFrame:
    """One wide row of counts."""
    p = papers.agg(F.count("*").alias("papers"), F.count_if(F.col("source") != "abstract").alias("full_text"), F.max("published_at").alias("newest"), F.countDistinct("primary_category").alias("categories"))
    c = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("paper_id").alias("chunked_papers"))
    a = authors.agg(F.countDistinct("name").alias("authors"))
    return p.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(a))  # three single rows


def counts_by(papers: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return papers.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def newest_age(papers: DataFrame, now) -> DataFrame:
    """Age in days of the newest paper, and whether it is stale (over 3 days)."""
    days = F.datediff(F.lit(now).cast("timestamp"), F.max("published_at"))
    return papers.agg(days.alias("age_days"), (days > 3).alias("stale"))
