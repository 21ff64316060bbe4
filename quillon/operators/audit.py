"""Consistency audits, each a table of offenders, and one row of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    return chunks.join(papers.select("paper_id"), "paper_id", "left_anti").select("paper_id", "idx")


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id", "idx").agg(F.count("*").alias("n")).where("n > 1")


def gappy(chunks: DataFrame) -> DataFrame:
    """Papers whose passage numbers are not 0 to n - 1."""
    return chunks.groupBy("paper_id").agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.min("idx").alias("first")).where("last + 1 <> n or first <> 0")


def without_authors(papers: DataFrame, authors: DataFrame) -> DataFrame:
    return papers.join(authors.select("paper_id"), "paper_id", "left_anti").select("paper_id")


def summary(papers: DataFrame, chunks: DataFrame, authors: DataFrame) -> DataFrame:
    parts = {"orphan_chunks": orphan_chunks(chunks, papers), "duplicate_chunks": duplicate_chunks(chunks), "gappy_papers": gappy(chunks), "papers_without_authors": without_authors(papers, authors)}
    out = None
    for name, rows in parts.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("audit"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def log_matches_seen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages in the log, members of the seen set, and whether they agree."""
    a, b = messages.agg(F.count("*").alias("messages")), seen.agg(F.count("*").alias("seen"))
    return a.crossJoin(F.broadcast(b)).withColumn("equal", F.col("messages") == F.col("seen"))  # single rows


def consumer_lag(produced: DataFrame, committed: DataFrame) -> DataFrame:
    """(topic, consumer, lag): highest offset of each topic less what each consumer group has committed, over partitions."""
    most = produced.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))
    done = committed.groupBy("consumer", "topic", "partition").agg(F.max("offset").alias("at"))
    return done.join(most, ["topic", "partition"]).groupBy("topic", "consumer").agg(F.sum(F.col("end") - F.col("at")).alias("lag"))
