"""Ingestion as Structured Streaming: validate, route, deduplicate, embed and merge, and dead letters for the rest.

Each micro-batch changes papers, passages and authors in one commit (see tables.py), so a crash at any point loses nothing and shows no
half batch, and a batch that is run again changes nothing. A message that fails for a passing reason goes to the retry log with its number
of attempts and the time of the next one; a second stream holds it until then (see retry.py) and merges it like any other. After
`tries` attempts, or at once for a lasting error or an invalid message, it is a dead letter with its attempts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import schema
from quillon.functions.text import strip_nul
from quillon.operators.dlq import dead_letter
from quillon.operators.merge import accepted, newest, replace_by_paper, upsert_papers
from quillon.sources.providers import BACKOFF, RETRIES, Embedder, embed_each
from quillon.streaming.retry import WAITING, due
from quillon.streaming.tables import Change, Snapshot, Tables

AUTHORS = "paper_id string, position int, name string"


def classify(messages: DataFrame) -> DataFrame:
    """Log rows (key, value) with kind and violation."""
    kind = F.when(F.get_json_object("value", "$.chunks").isNotNull(), "chunked").otherwise("paper")
    return messages.withColumn("kind", kind).withColumn("violation", schema.violation(F.col("kind"), F.col("value")))


def documents(valid: DataFrame) -> DataFrame:
    """(value, attempts, paper, source, chunks): full-text messages as they are, paper messages as one passage of title and abstract."""
    full = valid.where("kind = 'chunked'").select("value", "attempts", F.from_json("value", schema.CHUNKED).alias("m")).select("value", "attempts", "m.paper", "m.source", "m.chunks")
    plain = valid.where("kind = 'paper'").select("value", "attempts", F.from_json("value", schema.PAPER).alias("paper"))
    body = F.concat("paper.title", F.lit("\n\n"), "paper.abstract")
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")))
    one = F.struct(F.lit(0).alias("idx"), F.lit("abstract").alias("section"), body.alias("text"), words.alias("token_count"))
    return full.unionByName(plain.select("value", "attempts", "paper", F.lit("abstract").alias("source"), F.array(one).cast(f"array<{schema.CHUNK}>").alias("chunks")))


def paper_rows(docs: DataFrame, now) -> DataFrame:
    p = lambda c: F.col(f"paper.{c}")
    when = lambda c: F.try_to_timestamp(p(c))
    return docs.select(
        p("arxiv_id").alias("paper_id"), p("version").alias("version"), strip_nul(p("title")).alias("title"), strip_nul(p("abstract")).alias("abstract"), p("primary_category").alias("primary_category"), p("categories").alias("categories"),
        when("published_at").alias("published_at"), when("updated_at").alias("updated_at"), p("pdf_url").alias("pdf_url"), p("html_url").alias("html_url"), p("doi").alias("doi"), p("journal_ref").alias("journal_ref"), p("comment").alias("comment"),
        "source", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("summary_model"), now.alias("ingested_at"), now.alias("processed_at"), p("authors").alias("authors"), "chunks", "value", "attempts",
    )


def merge_batch(tables: Tables, embedder: Embedder, now_of: Callable[[int], object], writer: str = "main", tries: int = RETRIES, pauses: tuple[float, ...] = BACKOFF) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over (key, value) or, from the retry queue, (key, value, attempts): guarded upsert of papers, replacement of
    their passages and authors, retry log and dead letters under the batch's own folder (a batch that runs again writes them over).

    Messages whose paper is already stored at that version with full text are dropped before any embedding."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = now_of(batch_id)
        if "attempts" not in batch.columns:
            batch = batch.withColumn("attempts", F.lit(0))
        rows = classify(batch).persist()
        bad = rows.where("violation is not null").select(F.col("key").alias("paper_id"), F.col("violation").alias("error"), (F.col("attempts") + 1).alias("attempts"), F.col("value").alias("payload"))
        new = paper_rows(documents(rows.where("violation is null")), now).persist()
        touched = tables.touched(new)
        failed, held = [], [rows, new]

        def change(snapshot: Snapshot) -> Change:
            current = snapshot.read("papers", schema.PAPERS_TABLE, touched)
            own = accepted(current, newest(new)).persist()
            passages = own.select("paper_id", "attempts", F.inline("chunks")).withColumn("text", strip_nul(F.col("text")))
            passages = embed_each(passages, embedder).persist()
            failures = passages.where("error is not null").groupBy("paper_id").agg(F.min("error").alias("error"), F.min("passing").alias("passing"))
            held.extend((own, passages))
            failed[:] = [own.join(failures, "paper_id")]
            own = own.join(failures.select("paper_id"), "paper_id", "left_anti")
            passages = passages.join(failures.select("paper_id"), "paper_id", "left_anti")
            names = own.select("paper_id", F.posexplode("authors").alias("position", "name")).dropDuplicates(["paper_id", "name"])
            return {
                "papers": (upsert_papers(current, own.select(*schema.names(schema.PAPERS_TABLE))), touched),
                "chunks": (replace_by_paper(snapshot.read("chunks", schema.CHUNKS_TABLE, touched), passages.select(*schema.names(schema.CHUNKS_TABLE))), touched),
                "authors": (replace_by_paper(snapshot.read("authors", AUTHORS, touched), names), touched),
            }

        def note(snapshot: Snapshot) -> Change:
            """The change, with retries and dead letters written before it is committed."""
            made = change(snapshot)
            lost = failed[0].withColumn("attempts", F.col("attempts") + 1)
            again = F.col("passing") & (F.col("attempts") < tries)
            pause = F.element_at(F.array(*[F.lit(float(x)) for x in pauses]), F.least("attempts", F.lit(len(pauses))))
            wait = lost.where(again).select(F.col("paper_id").alias("key"), "value", "attempts", "error", (F.unix_millis(F.current_timestamp()) + 1000 * pause).cast("long").alias("due"))
            wait.coalesce(1).write.mode("overwrite").parquet(f"{tables.path}/retry/writer={writer}/batch={batch_id}")
            dead = bad.unionByName(lost.where(~again).select("paper_id", "error", "attempts", F.col("value").alias("payload")))
            dead_letter(dead, "worker", now).write.mode("overwrite").parquet(f"{tables.path}/dead/writer={writer}/batch={batch_id}")
            return made

        tables.transact(note, writer, batch_id)
        for df in held:
            df.unpersist()

    return run


def start(messages: DataFrame, tables: Tables, embedder: Embedder, checkpoint: str, now_of: Callable[[int], object], **more):
    """The ingestion query over a message stream; its checkpoint replaces offset commits."""
    return messages.writeStream.foreachBatch(merge_batch(tables, embedder, now_of, **more)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_retries(tables: Tables, embedder: Embedder, checkpoint: str, now_of: Callable[[int], object], every: str = "1 second", **more):
    """The query that merges what the retry log holds, each message when it is due. It goes on until it is stopped."""
    spark = tables.spark
    tables._fs.mkdirs(tables._path("retry"))
    waiting = spark.readStream.schema(WAITING).option("recursiveFileLookup", True).parquet(f"{tables.path}/retry")
    batches = merge_batch(tables, embedder, now_of, **({"writer": "retry"} | more))
    return due(waiting).drop("error").writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
