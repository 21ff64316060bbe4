"""Versioned upserts on parquet tables as join-and-rewrite plans: the caller writes the result and swaps it in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import author_norm

FULL_TEXT = ("html", "pdf")


def newest(rows: DataFrame) -> DataFrame:
    """Of several arrivals of one paper in a batch one: the highest version, full text before abstract, then the latest arrival."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("version"), F.col("source").isin(*FULL_TEXT).desc(), F.desc("processed_at"), "source")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def accepted(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that may replace what is stored: an abstract never replaces full text of the same or a later version. Full text always
    may, also of an older version that arrives late."""
    old = current.select("paper_id", F.col("source").alias("old_source"), F.col("version").alias("old_version"))
    downgrade = (F.col("source") == "abstract") & F.col("old_source").isin(*FULL_TEXT) & (F.col("old_version") >= F.col("version"))
    return new.join(old, "paper_id", "left").where(~F.coalesce(downgrade, F.lit(False))).drop("old_source", "old_version")


def upsert_papers(current: DataFrame, new: DataFrame) -> DataFrame:
    """The papers table after `new`: guarded replacement; a null summary or model keeps the stored one; ingested_at is that of the first row."""
    own = accepted(current, newest(new))
    old = current.select("paper_id", F.col("ingested_at").alias("first_ingested"), F.col("summary").alias("old_summary"), *([F.col("summary_model").alias("old_model")] if "summary_model" in current.columns else []))
    rows = own.join(old, "paper_id", "left")
    if "old_model" in rows.columns:
        rows = rows.withColumn("summary_model", F.coalesce("summary_model", "old_model")).drop("old_model")
    rows = rows.withColumn("summary", F.coalesce("summary", "old_summary")).withColumn("ingested_at", F.coalesce("first_ingested", "ingested_at")).drop("first_ingested", "old_summary")
    return current.join(own.select("paper_id"), "paper_id", "left_anti").unionByName(rows.select(*current.columns))


def replace_by_paper(current: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the papers in new are replaced: passages, author lists, citation edges."""
    return current.join(new.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(new)


def upsert_authors(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors, paper_authors) from (paper_id, position, name, seen_at): one author a normalised name, shown as first seen; a name
    that repeats in a paper keeps its first position."""
    rows = names.withColumn("name_norm", author_norm("name"))
    authors = rows.groupBy("name_norm").agg(F.min_by("name", F.struct("seen_at", "paper_id", "position")).alias("name"))
    return authors, rows.groupBy("paper_id", "name_norm").agg(F.min("position").alias("position"))


def latest_wins(current: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Keyed rows of which the largest `version` columns win; of equal ones the new row."""
    both = current.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in version], F.desc("is_new"))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "is_new")


def claimable(jobs: DataFrame, claims: DataFrame, now, stale_seconds: int = 900) -> DataFrame:
    """Claims (paper_id, provider, version, model, prompt_version) that may start: no job yet, a failed one, one that runs for too long,
    or one that is done for another input."""
    inputs = ("version", "model", "prompt_version")
    old = jobs.select("paper_id", "provider", "status", "started_at", F.struct(*inputs).alias("was"))
    rows = claims.join(old, ["paper_id", "provider"], "left")
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(secs=F.lit(stale_seconds)))
    changed = (F.col("status") == "done") & ~F.col("was").eqNullSafe(F.struct(*inputs))
    free = F.col("status").isNull() | (F.col("status") == "failed") | stale | changed
    return rows.where(free).select(*claims.columns)


def claim(jobs: DataFrame, claims: DataFrame, now, stale_seconds: int = 900) -> DataFrame:
    """The job table with the claims that may start as running."""
    own = claimable(jobs, claims, now, stale_seconds)
    rows = own.withColumn("status", F.lit("running")).withColumn("started_at", now)
    return jobs.join(own.select("paper_id", "provider"), ["paper_id", "provider"], "left_anti").unionByName(rows, allowMissingColumns=True)


def finish(jobs: DataFrame, results: DataFrame, now) -> DataFrame:
    """Running jobs get the status, result and cost of `results` (paper_id, provider, new_status, ...)."""
    extra = [c for c in results.columns if c not in ("paper_id", "provider", "new_status")]
    rows = jobs.drop(*extra).join(results, ["paper_id", "provider"], "left")
    done = F.col("new_status").isNotNull()
    return rows.withColumn("status", F.coalesce("new_status", "status")).withColumn("finished_at", F.when(done, now)).drop("new_status")
