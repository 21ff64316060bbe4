"""What to read next: candidates from citations and similarity, decayed along the path, picked under two caps, as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import similar_weight
from quillon.operators.trail import reading_order, recent
from quillon.operators.vectors import neighbors

#: Fixed parameters of scoring and picking.
RECENT, DECAY, SIMILAR, PER_SOURCE, LIMIT, EXTERNAL_SHARE = 8, 0.85, 12, 4, 12, 0.34
WEIGHTS = {"builds_on": 0.35, "follow_up": 0.6}
DIGITS = 6
NUDGE = 1e-10  # sums that end in a 5 behind the last digit round alike in any order


def reasons(trail: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(web_id, key, other_id, kind, source, weight): why each candidate is one, of the last papers of each web's path."""
    order = Window.partitionBy("web_id").orderBy(F.desc("added_at"), F.desc("paper_id"))
    path = recent(trail, RECENT).select("web_id", F.col("paper_id").alias("source"), F.pow(F.lit(DECAY), F.row_number().over(order) - 1).alias("decay"))
    kind = F.when(F.col("direction") == "cites", "builds_on").otherwise("follow_up")
    cited = path.join(citations.select(F.col("paper_id").alias("source"), "direction", F.col("other_key").alias("key"), "other_id"), "source")
    cited = cited.select("web_id", "key", F.col("other_id").cast("long").alias("other_id"), kind.alias("kind"), "source", (F.col("decay") * F.when(kind == "builds_on", WEIGHTS["builds_on"]).otherwise(WEIGHTS["follow_up"])).alias("weight"))
    near = neighbors(path.select(F.col("source").alias("query_id")).distinct(), chunks, SIMILAR)
    near = path.join(near, path.source == near.query_id).select("web_id", F.concat(F.lit("arxiv:"), F.col("paper_id").cast("string")).alias("key"), F.col("paper_id").alias("other_id"), F.lit("similar").alias("kind"), "source", (F.col("decay") * similar_weight(F.col("sim"))).alias("weight"))
    return cited.unionByName(near)


def scored(found: DataFrame) -> DataFrame:
    """(web_id, key, other_id, score, n_reasons, source): weights are summed over all reasons; of reasons with one kind and source one is
    counted; source is that of the heaviest."""
    first = Window.partitionBy("web_id", "key", "kind", "source")
    rows = found.withColumn("nth", F.row_number().over(first.orderBy(F.desc("weight"))))
    heaviest = F.min_by("source", F.struct(-F.round("weight", 3), "kind", "source"))
    return rows.groupBy("web_id", "key").agg(F.max("other_id").alias("other_id"), F.round(F.sum("weight") + NUDGE, DIGITS).alias("score"), F.count_if(F.col("nth") == 1).alias("n_reasons"), heaviest.alias("source"))


def without(candidates: DataFrame, trail: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Candidates that are on no trail and not dismissed, by key or by id."""
    ids = trail.select(F.col("paper_id").cast("long").alias("other_id"))
    keys = ids.select(F.concat(F.lit("arxiv:"), F.col("other_id").cast("string")).alias("key"))
    if dismissed is not None:
        keys = keys.unionByName(dismissed.select("key"))
        number = F.regexp_extract("key", "^arxiv:([0-9]+)$", 1)
        ids = ids.unionByName(dismissed.select(number.try_cast("long").alias("other_id")).where("other_id is not null"))
    return candidates.join(keys.distinct(), "key", "left_anti").join(ids.distinct(), "other_id", "left_anti").select(*candidates.columns)


def pick(candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(web_id, place, key, other_id, score, source): greedily by score, with a cap on each source and one on papers outside the index.

    The choice depends on all earlier choices, so each web's ranked candidates are folded in order inside one expression; a web
    holds at most the candidates of its last 8 papers, hence a bounded array."""
    row = F.struct((-F.col("score")).alias("minus"), "key", "other_id", "score", "source")
    ranked = candidates.groupBy("web_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.countDistinct("source").alias("sources"))
    cap = F.greatest(F.lit(PER_SOURCE), F.ceil(F.lit(limit) / F.greatest(F.lit(1), "sources")).cast("int"))
    outside_cap = max(1, round(limit * EXTERNAL_SHARE))
    item = "struct<minus:double,key:string,other_id:bigint,score:double,source:bigint>"
    empty = F.from_json(F.lit("[]"), f"array<{item}>")

    def step(acc, x):
        same = F.size(F.filter(acc, lambda y: y["source"].eqNullSafe(x["source"])))
        outside = F.size(F.filter(acc, lambda y: y["other_id"].isNull()))
        full = (F.size(acc) >= limit) | (same >= F.col("cap")) | (x["other_id"].isNull() & (outside >= outside_cap))
        return F.when(full, acc).otherwise(F.concat(acc, F.array(x)))

    rows = F.transform("rows", lambda x: x.cast(item))
    folded = ranked.withColumn("cap", cap).select("web_id", F.aggregate(rows, empty, step).alias("chosen"))
    out = folded.select("web_id", F.posexplode("chosen").alias("place", "c"))
    return out.select("web_id", (F.col("place") + 1).alias("place"), "c.key", "c.other_id", "c.score", "c.source")


def graph_edges(trail: DataFrame, picked: DataFrame, found: DataFrame, citations: DataFrame, papers: DataFrame) -> DataFrame:
    """(web_id, source, target, type), each once: consecutive papers of a path, why each suggestion is there, and citations on the path.
    A follow-up's edge points from the suggestion to the path's paper."""
    text = lambda c: F.col(c).cast("string")
    path = reading_order(trail).where("next_id is not null").select("web_id", text("paper_id").alias("source"), text("next_id").alias("target"), F.lit("trail").alias("type"))
    known = papers.select(F.col("paper_id").alias("other_id"), F.lit(True).alias("known"))
    nodes = picked.select("web_id", "key", "other_id").join(known, "other_id", "left").select("web_id", "key", F.when(F.col("known"), text("other_id")).otherwise(F.col("key")).alias("node"))
    why = found.select("web_id", "key", "kind", "source").distinct().join(nodes, ["web_id", "key"])
    follow = F.col("kind") == "follow_up"
    why = why.select("web_id", F.when(follow, F.col("node")).otherwise(text("source")).alias("source"), F.when(follow, text("source")).otherwise(F.col("node")).alias("target"), F.when(F.col("kind") == "similar", "similar").otherwise("builds_on").alias("type"))
    on_path = trail.select("web_id", "paper_id")
    cited = on_path.join(citations.where("direction = 'cites' and other_id is not null"), "paper_id").select("web_id", "paper_id", F.col("other_id").cast("long").alias("other_id"))
    cited = cited.join(on_path.withColumnRenamed("paper_id", "other_id"), ["web_id", "other_id"]).select("web_id", text("paper_id").alias("source"), text("other_id").alias("target"), F.lit("builds_on").alias("type"))
    return path.unionByName(why).unionByName(cited).distinct()


def graph_nodes(trail: DataFrame, picked: DataFrame, papers: DataFrame) -> DataFrame:
    """(web_id, id, kind, place, title, in_index): the path in reading order, then the suggestions."""
    path = reading_order(trail).join(papers.select("paper_id", "title"), "paper_id", "left").select("web_id", F.col("paper_id").cast("string").alias("id"), F.lit("path").alias("kind"), "place", "title", F.lit(True).alias("in_index"))
    known = papers.select(F.col("paper_id").alias("other_id"), "title")
    suggested = picked.join(known, "other_id", "left")
    inside = F.col("title").isNotNull()
    suggested = suggested.select("web_id", F.when(inside, F.col("other_id").cast("string")).otherwise(F.col("key")).alias("id"), F.lit("suggestion").alias("kind"), "place", F.coalesce("title", "key").alias("title"), inside.alias("in_index"))
    return path.unionByName(suggested)


def pending(trail: DataFrame, fetched: DataFrame) -> DataFrame:
    """Papers of each web whose citations are not fetched yet."""
    return trail.select("web_id", "paper_id").distinct().join(fetched.select("paper_id"), "paper_id", "left_anti").groupBy("web_id").agg(F.count("*").alias("pending"))


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair of a web: trail before builds_on before similar."""
    rank = F.when(F.col("type") == "trail", 0).when(F.col("type") == "builds_on", 1).otherwise(2)
    pair = Window.partitionBy("web_id", F.least("source", "target"), F.greatest("source", "target")).orderBy(rank, "source", "target")
    return edges.withColumn("r", F.row_number().over(pair)).where("r = 1").drop("r")


def strength(picked: DataFrame) -> DataFrame:
    """Drawing strength of suggestions: the root of the share of the web's highest score."""
    return picked.withColumn("strength", F.round(F.sqrt(F.col("score") / F.max("score").over(Window.partitionBy("web_id"))), DIGITS))
