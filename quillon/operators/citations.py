"""Citation edges: from citation records and bibliographies, title resolution, status rules and replacement by paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import edge_key, norm_title

MAX_EDGES, BATCH = 500, 500
_OTHER = "array<struct<paperId:string,title:string,year:int,externalIds:struct<ArXiv:string>>>"
RECORD = f"references {_OTHER}, citations {_OTHER}"


def from_records(records: DataFrame, cap: int = MAX_EDGES) -> DataFrame:
    """(paper_id, position, direction, other_key, other_id, title, year) from (paper_id, record json): at most `cap` a direction, in
    order, ids without version; entries that have no key are dropped."""
    parsed = records.select("paper_id", F.from_json("record", RECORD).alias("r"))
    parts = []
    for direction, field in (("cites", "references"), ("cited_by", "citations")):
        parts.append(parsed.select("paper_id", F.lit(direction).alias("direction"), F.posexplode(F.slice(F.coalesce(F.col(f"r.{field}"), F.array().cast(parsed.schema["r"].dataType[field].dataType)), 1, cap)).alias("position", "o")))
    rows = parts[0].unionByName(parts[1])
    own = F.nullif(F.regexp_replace("o.externalIds.ArXiv", "v.*$", ""), F.lit(""))
    rows = rows.select("paper_id", "position", "direction", edge_key(own, F.col("o.paperId"), F.col("o.title")).alias("other_key"), own.alias("other_id"), F.col("o.title").alias("title"), F.col("o.year").alias("year"))
    return rows.where("other_key is not null")


def resolve_titles(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Title-only edges get the id of the indexed paper with that normalised title (of several the largest id)."""
    titles = papers.groupBy(norm_title(F.col("title")).alias("norm")).agg(F.max(F.col("paper_id")).cast("string").alias("indexed"))
    lone = F.col("other_id").isNull() & F.col("title").isNotNull()
    rows = edges.withColumn("norm", F.when(lone, norm_title(F.col("title")))).join(titles, "norm", "left")
    rows = rows.withColumn("other_key", F.when(F.col("indexed").isNotNull(), F.concat(F.lit("arxiv:"), "indexed")).otherwise(F.col("other_key")))
    return rows.withColumn("other_id", F.coalesce("other_id", "indexed")).drop("norm", "indexed")


def status(papers: DataFrame, edges: DataFrame, fetched: DataFrame) -> DataFrame:
    """(paper_id, status) from fetch outcomes (paper_id, api_ok, html): done, partial (the citation service was out), missing, failed.

    html is ok, none or failed. References from the service alone are enough for done."""
    n = edges.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if((F.col("direction") == "cites") & (F.col("via") == "api")).alias("refs"))
    rows = papers.select("paper_id").join(fetched, "paper_id").join(n, "paper_id", "left").na.fill(0, ["n", "refs"])
    what = F.when(F.col("refs") > 0, "done").when(F.col("html") == "failed", "failed").when(~F.col("api_ok"), "partial").when(F.col("n") > 0, "done").otherwise("missing")
    return rows.select("paper_id", what.alias("status"))


def fresh(fetches: DataFrame, now) -> DataFrame:
    """Papers whose cached citations still hold: complete ones, or incomplete ones fetched within a day."""
    return fetches.where(~F.col("status").isin("failed", "partial") | (F.col("fetched_at") > now - F.expr("INTERVAL 1 DAY"))).select("paper_id")


def counts(edges: DataFrame) -> DataFrame:
    """References and citations of each paper before edges with one key are merged."""
    return edges.groupBy("paper_id").agg(F.count_if(F.col("direction") == "cites").alias("n_refs"), F.count_if(F.col("direction") == "cited_by").alias("n_cites"))


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (paper, direction, key)."""
    order = Window.partitionBy("paper_id", "direction", "other_key").orderBy("position")
    return edges.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def store(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The edge table after the papers of `new` are replaced."""
    return stored.join(new.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(unique_edges(new), allowMissingColumns=True)
