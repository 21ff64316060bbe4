"""SQL names for the functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillon.functions import extract
from quillon.functions.stem import lexemes
from quillon.functions.text import PAPER_ID, QUOTED_TITLE, YEAR, author_norm

#: SQL functions of built-in expressions: parameters and body.
SQL_FUNCTIONS = {
    "norm_title": ("s STRING", "STRING", "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' '))"),
    "parse_paper_id": ("s STRING", "STRING", f"nullif(regexp_extract(trim(s), r'{PAPER_ID}', 1), '')"),
    "similar_weight": ("sim DOUBLE", "DOUBLE", "least(1.0D, greatest(0.1D, (sim - 0.6D) / 0.2D))"),
    "cosine_sim": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)))",
    ),
    "identifiers": ("q STRING", "ARRAY<STRING>", r"array_sort(array_distinct(filter(regexp_extract_all(q, '(?U)[\\w.+-]+', 0), t -> t rlike '[0-9]' or t rlike '(?U)^.+\\p{Lu}')))"),
}


@F.pandas_udf(ArrayType(StringType()))
def lexemes_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [x for x, _ in lexemes(t)])


class _Sections:
    def eval(self, html: str) -> Iterator[tuple]:
        for place, (title, text) in enumerate(extract.sections(html, extract.PAPER) or extract.sections(html, extract.GENERIC)):
            yield place, title, text


class _Chunks:
    def eval(self, text: str, tokens: int, overlap: int) -> Iterator[tuple]:
        words = (text or "").split()
        start = 0
        while start < len(words):
            yield start, " ".join(words[start : start + tokens])
            if start + tokens >= len(words):
                return
            start += tokens - overlap


class _References:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from extract.references(html)


class _Figures:
    def eval(self, html: str, base: str) -> Iterator[tuple]:
        for x in extract.figures(html, base or ""):
            yield x["n"], x["caption"], x["images"]


TABLE_FUNCTIONS = {
    "extract_sections": (_Sections, "place int, title string, text string"),
    "chunk_text": (_Chunks, "start int, text string"),
    "bibliography_items": (_References, "text string, links string, marked_title string, marked_year string"),
    "parse_figures": (_Figures, "n int, caption string, images array<string>"),
}


#: The reading of bibliography_items as references, as extract.read_references has it.
_PARSE_BIBLIOGRAPHY = rf"""
CREATE OR REPLACE TEMPORARY FUNCTION parse_bibliography(html STRING) RETURNS TABLE(other_id STRING, title STRING, year INT) RETURN
SELECT other_id, title, year FROM (
  SELECT nullif(regexp_extract(concat_ws(' ', links, text), r'{extract.REFERENCE_ID}', 1), '') AS other_id,
    coalesce(nullif(regexp_replace(marked_title, '^[ .]+|[ .]+$', ''), ''), nullif(trim(regexp_replace(regexp_extract(text, r'{QUOTED_TITLE}', 1), '^[ ,.]+|[ ,.]+$', '')), '')) AS title,
    coalesce(cast(nullif(regexp_extract(marked_year, '(?:19|20)[0-9]{{2}}', 0), '') AS INT), cast(try_element_at(regexp_extract_all(text, r'{YEAR}', 0), -1) AS INT)) AS year
  FROM bibliography_items(parse_bibliography.html)) WHERE other_id IS NOT NULL OR title IS NOT NULL
"""


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for SQL; returns their names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("author_norm", author_norm)
    spark.udf.register("lexemes", lexemes_udf)
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema).asDeterministic())
    spark.sql(_PARSE_BIBLIOGRAPHY)
    return sorted([*SQL_FUNCTIONS, "author_norm", "lexemes", *TABLE_FUNCTIONS, "parse_bibliography"])
