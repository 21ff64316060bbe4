"""Retrieval quality, latency distributions and load summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): place of the expected paper among a query's results, null if it is not there."""
    want = expected.select("query_id", F.col("paper_id").alias("want"))
    places = found.join(want, "query_id").where("paper_id = want").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return want.select("query_id").join(places, "query_id", "left")


def retrieval_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Recall at 1, 5 and k, mean reciprocal rank, number of queries."""
    hit = lambda n: F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6)
    return ranked.agg(F.count("*").alias("n"), hit(1).alias("recall_1"), hit(5).alias("recall_5"), hit(k).alias("recall_k"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def category_precision(found: DataFrame, expected: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, precision): share of a query's results that have the expected category."""
    rows = found.join(expected.select("query_id", "category"), "query_id").join(papers.select("paper_id", "categories"), "paper_id")
    return rows.groupBy("query_id").agg(F.round(F.avg(F.array_contains("categories", F.col("category")).cast("double")), 6).alias("precision"))


def percentiles(samples: DataFrame, column: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Nearest-rank p50, p95 and p99, mean, largest and number of a column."""
    at = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), digits)
    return samples.groupBy(*(by or [])).agg(F.count(column).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.avg(column), digits).alias("mean"), F.round(F.max(column), digits).alias("max"))


def load_summary(samples: DataFrame, wall_seconds: float) -> DataFrame:
    """Requests, errors, requests a second, cached share, and mean time of cached and other requests (cached, error, ms)."""
    good = ~F.col("error")
    mean = lambda c: F.round(F.avg(F.when(good & c, F.col("ms"))), 6)
    return samples.agg(
        F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.round(F.count_if(good) / wall_seconds, 6).alias("rps"),
        F.round(F.try_divide(F.count_if(good & F.col("cached")), F.count_if(good)), 6).alias("cached_rate"), mean(F.col("cached")).alias("cached_ms"), mean(~F.col("cached")).alias("uncached_ms"),
    )


def scorecard(designs: DataFrame) -> DataFrame:
    """Of checked designs (paper_id, seconds, rejected array<struct<kind>>, evidence_kept): median time and rejected claims by kind."""
    kinds = designs.select("paper_id", F.explode_outer("rejected.kind").alias("kind"))
    total = designs.agg(F.count("*").alias("designs"), F.round(F.median("seconds"), 6).alias("median_seconds"), F.sum("evidence_kept").alias("evidence_kept"))
    counts = kinds.where("kind is not null").groupBy("kind").agg(F.count("*").alias("rejected"))
    return counts.crossJoin(F.broadcast(total))  # total is one row


def poll_summary(polls: DataFrame) -> DataFrame:
    """Fetched, produced and duplicate papers of each category and cycle, and whether the page cap left a gap."""
    return polls.groupBy("cycle", "category").agg(F.sum("fetched").alias("fetched"), F.sum("new").alias("produced"), (F.sum("fetched") - F.sum("new")).alias("duplicates"), F.min("oldest").alias("oldest_seen"), F.max((F.col("page") >= F.col("cap")) & (F.col("new") > 0)).alias("capped"))


def sample_by_hash(papers: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """n rows in an order that depends on the id and the seed alone."""
    return papers.orderBy(F.md5(F.concat(F.col("paper_id").cast("string"), F.lit(seed))), "paper_id").limit(n)
