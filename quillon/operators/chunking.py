"""Passages: overlapping token windows of sections, behind a first passage of title and abstract."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS, OVERLAP, MOST, LEAST = 512, 64, 120, 8


def windows(sections: DataFrame, tokens: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(paper_id, place, start, token_count, text) of white-space tokens: windows of `tokens`, each sharing `overlap` with the last;
    sections under LEAST tokens give none. sections: (paper_id, place, title, text). Native expressions alone."""
    step = tokens - overlap
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = sections.withColumn("words", words).withColumn("n", F.size("words")).where(F.col("n") >= LEAST)
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - tokens) / step)).cast("int")
    piece = lambda w: F.slice(F.col("words"), w * step + 1, tokens)
    own = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct((w * step).cast("long").alias("start"), F.size(piece(w)).cast("long").alias("token_count"), F.array_join(piece(w), " ").alias("text")))
    # the pieces are cut before the explode, which would copy all words of a section to each of its windows
    return rows.select("paper_id", "place", "title", F.inline(own))


def chunks(papers: DataFrame, sections: DataFrame, tokens: int = TOKENS, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """(paper_id, idx, section, text, token_count): passage 0 is title and abstract, then the windows with their section's title as
    the first line; at most `most` a paper, numbered without gaps."""
    order = Window.partitionBy("paper_id").orderBy("place", "start")
    own = windows(sections, tokens, overlap).withColumn("idx", F.row_number().over(order).cast("long")).where(F.col("idx") < most)
    own = own.select("paper_id", "idx", F.col("title").alias("section"), F.concat("title", F.lit("\n"), "text").alias("text"), "token_count")
    body = F.concat("title", F.lit("\n\n"), "abstract")
    lead = papers.select("paper_id", F.lit(0).cast("long").alias("idx"), F.lit("abstract").alias("section"), body.alias("text"), F.greatest(F.lit(1), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))).cast("long").alias("token_count"))
    return lead.unionByName(own)


def token_chunks(sections: DataFrame, offsets: Callable[[str], list[tuple[int, int]]], tokens: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Windows of any tokenizer that gives character offsets, e.g. of the tokenizers library: the text is a slice of the original.

    `offsets` is called in the tasks; a tokenizer file's path is its own parameter."""

    def task(batches):
        for batch in batches:
            out: list[tuple] = []
            for paper, place, title, text in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "place", "title", "text"))):
                spans = offsets(text or "")
                n, start = len(spans), 0
                while n >= LEAST and start < n:
                    end = min(start + tokens, n)
                    piece = text[spans[start][0] : spans[end - 1][1]].strip()
                    if piece:
                        out.append((paper, place, title, start, end - start, piece))
                    if end == n:
                        break
                    start = end - overlap
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["paper_id", "place", "title", "start", "token_count", "text"])

    rows = sections.select(F.col("paper_id").cast("long").alias("paper_id"), F.col("place").cast("long").alias("place"), "title", "text")
    return rows.mapInArrow(task, "paper_id long, place long, title string, start long, token_count long, text string")
