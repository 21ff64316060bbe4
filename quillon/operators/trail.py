"""Reading trails: webs of read papers, the assignment of a paper to a web, and edits of both tables.

trail: (paper_id, web_id, added_at, ...), one row a paper. webs: (web_id, name, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import web_name
from quillon.operators.vectors import neighbors

NEIGHBORS, RECENT, DWELL_SECONDS = 50, 5, 10
KINDS = ("builds_on", "followed_by", "similar", "search", "manual")


def recent(trail: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n papers of each web."""
    order = Window.partitionBy("web_id").orderBy(F.desc("added_at"), F.desc("paper_id"))
    return trail.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def activity(trail: DataFrame) -> DataFrame:
    """(web_id, papers, last_added, place): webs by their last addition."""
    webs = trail.groupBy("web_id").agg(F.count("*").alias("papers"), F.max("added_at").alias("last_added"))
    # one row a web reaches this window, and its rank is the wanted global order
    return webs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_added"), "web_id")))


def reading_order(trail: DataFrame) -> DataFrame:
    """Each web's path: (web_id, place, paper_id, next_id)."""
    order = Window.partitionBy("web_id").orderBy("added_at", "paper_id")
    return trail.select("web_id", F.row_number().over(order).alias("place"), "paper_id", F.lead("paper_id").over(order).alias("next_id"))


def nearest_web(targets: DataFrame, trail: DataFrame, chunks: DataFrame, k: int = NEIGHBORS, n: int = RECENT) -> DataFrame:
    """(paper_id, web_id, sim) for each target that is among the k neighbours of a web's last n papers: the web of the highest
    similarity; of equal ones the web that was active last."""
    last = recent(trail, n).select("web_id", F.col("paper_id").alias("query_id"))
    near = neighbors(last.select("query_id").distinct(), chunks, k).join(targets.select("paper_id"), "paper_id", "left_semi")
    active = trail.groupBy("web_id").agg(F.max("added_at").alias("last_added"))
    rows = near.join(last, "query_id").join(active, "web_id")
    best = Window.partitionBy("paper_id").orderBy(F.desc("sim"), F.desc("last_added"), "web_id")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("paper_id", "web_id", "sim")


def assign(targets: DataFrame, trail: DataFrame, webs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, web_id, how) for reads (paper_id, via, web_hint): the hinted web if it exists, the web of the paper read before,
    the nearest web, else null (a new web)."""
    hinted = webs.select(F.col("web_id").alias("hinted"))
    before = trail.select(F.col("paper_id").alias("via"), F.col("web_id").alias("via_web"))
    near = nearest_web(targets, trail, chunks).select("paper_id", F.col("web_id").alias("near_web"))
    rows = targets.join(hinted, targets.web_hint == hinted.hinted, "left").join(before, "via", "left").join(near, "paper_id", "left")
    how = F.when(F.col("hinted").isNotNull(), "hint").when(F.col("via_web").isNotNull(), "via").when(F.col("near_web").isNotNull(), "near").otherwise("new")
    return rows.select("paper_id", F.coalesce("hinted", "via_web", "near_web").alias("web_id"), how.alias("how"))


def record_reads(reads: DataFrame, trail: DataFrame, webs: DataFrame, chunks: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trail, webs) after a batch of reads (read_id, paper_id, via, kind, query, web_hint, at) that begin from the given state.

    A paper already on a trail stays; the first read of a paper in the batch counts; unknown kinds become search (with a query)
    or null. Papers without a web start one each, named by the query or the title, with ids after the largest."""
    first = Window.partitionBy("paper_id").orderBy("at", "read_id")
    new = reads.join(trail.select("paper_id"), "paper_id", "left_anti").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).when(F.col("query").isNotNull(), "search")
    placed = new.withColumn("kind", kind).join(assign(new, trail, webs, chunks).select("paper_id", "web_id"), "paper_id")
    start = webs.agg(F.coalesce(F.max("web_id"), F.lit(0)).alias("start"))
    fresh = placed.where("web_id is null").join(papers.select("paper_id", "title"), "paper_id", "left")
    # only reads that start a web reach this window, which numbers the new webs in order of time
    fresh = fresh.crossJoin(F.broadcast(start)).withColumn("web_id", F.col("start") + F.row_number().over(Window.orderBy("at", "read_id")))
    rows = placed.where("web_id is not null").select("paper_id", "web_id", "at", "via", "kind", "query").unionByName(fresh.select("paper_id", "web_id", "at", "via", "kind", "query"))
    added = rows.select("paper_id", "web_id", F.col("at").alias("added_at"), "via", "kind", "query")
    made = fresh.select("web_id", web_name(F.coalesce("title", F.col("paper_id").cast("string")), F.col("query")).alias("name"), F.col("at").alias("created_at"))
    return trail.unionByName(added, allowMissingColumns=True), webs.unionByName(made, allowMissingColumns=True)


def rename(webs: DataFrame, web_id: int, name: str) -> DataFrame:
    return webs.withColumn("name", F.when(F.col("web_id") == web_id, F.lit(name)).otherwise(F.col("name")))


def move(trail: DataFrame, paper_id: int, web_id: int) -> DataFrame:
    return trail.withColumn("web_id", F.when(F.col("paper_id") == paper_id, F.lit(web_id)).otherwise(F.col("web_id")))


def delete_web(trail: DataFrame, webs: DataFrame, web_id: int) -> tuple[DataFrame, DataFrame]:
    return trail.where(F.col("web_id") != web_id), webs.where(F.col("web_id") != web_id)


def remove(trail: DataFrame, webs: DataFrame, paper_id: int) -> tuple[DataFrame, DataFrame]:
    """Without a paper; a web that loses its last paper goes too."""
    left = trail.where(F.col("paper_id") != paper_id)
    emptied = trail.where(F.col("paper_id") == paper_id).select("web_id").join(left.select("web_id").distinct(), "web_id", "left_anti")
    return left, webs.join(emptied, "web_id", "left_anti")


def insert_ignore(table: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """table and those of rows whose key is new; of rows with one key one stays."""
    key = [key] if isinstance(key, str) else key
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def dwell(events: DataFrame, least: float = DWELL_SECONDS) -> DataFrame:
    """(user_id, paper_id, seconds) of pages seen for `least` seconds or more, from visibility events (user_id, paper_id, ts, visible):
    the time from each visible event to the next event, summed; hidden time does not count. Of events of one time the visible ones come first."""
    order = Window.partitionBy("user_id", "paper_id").orderBy("ts", F.desc("visible"))
    until = F.lead("ts").over(order)
    seconds = F.when(F.col("visible"), F.unix_micros(until) - F.unix_micros("ts")) / 1e6
    return events.withColumn("s", seconds).groupBy("user_id", "paper_id").agg(F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 3).alias("seconds")).where(F.col("seconds") >= least)


def visible_reads(views: DataFrame, clock: Column) -> DataFrame:
    """Reads at a given time from dwelled views."""
    return dwell(views).withColumn("at", clock)
