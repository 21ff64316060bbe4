"""Dead letters: what to replay, where to, and what is settled already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import error_text


def dead_letter(rows: DataFrame, stage: str, now) -> DataFrame:
    """Failed messages (paper_id, error, attempts, payload json) in the shape of the dead-letter log."""
    return rows.select(F.lit(1).alias("schema_version"), "paper_id", F.lit(stage).alias("stage"), error_text(F.col("error")).alias("error"), F.greatest(F.lit(1), F.col("attempts")).alias("attempts"), now.alias("failed_at"), "payload")


def replay_plan(failed: DataFrame, papers: DataFrame, invalid=None) -> DataFrame:
    """(paper_id, action, topic) of each paper's latest failure (of equal times the first by offset).

    The payload's shape tells the topic: passages mean full text, a title means a paper message, else it can't be replayed.
    invalid: a Column over the payload that is the first violation of its schema, or null. A failure is resolved if a stored
    row covers it: the same or a later version, with full text, or of any kind if the worker failed on a paper message."""
    latest = Window.partitionBy("paper_id").orderBy(F.desc("failed_at"), "offset")
    rows = failed.withColumn("r", F.row_number().over(latest)).where("r = 1")
    full = F.get_json_object("payload", "$.chunks").isNotNull()
    plain = F.get_json_object("payload", "$.title").isNotNull()
    version = F.coalesce(F.get_json_object("payload", "$.paper.version"), F.get_json_object("payload", "$.version"), F.lit("1")).cast("int")
    rows = rows.withColumn("kind", F.when(full, "chunked").when(plain, "paper")).withColumn("version", version).withColumn("invalid", invalid if invalid is not None else F.lit(None).cast("string"))
    rows = rows.join(papers.select("paper_id", F.col("version").alias("stored"), F.col("source").alias("stored_source")), "paper_id", "left")
    covered = (F.col("stored") >= F.col("version")) & ((F.col("stored_source") != "abstract") | ((F.col("kind") == "paper") & (F.col("stage") == "worker")))
    action = F.when(F.col("kind").isNull(), "unreplayable").when(F.col("invalid").isNotNull(), F.concat(F.lit("invalid payload ("), "invalid", F.lit(")"))).when(F.coalesce(covered, F.lit(False)), F.concat(F.lit("resolved (stored, source="), "stored_source", F.lit(")"))).otherwise("replay")
    topic = F.when(action == "replay", F.when(F.col("kind") == "chunked", "papers.chunked").otherwise("papers.new"))
    return rows.select("paper_id", action.alias("action"), topic.alias("topic"))
