"""Whole rows through a stage: columns of any name keep their values, their order and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns that the stages read or write, and that keep their names inside.
OWN = ("doc_id", "text", "n_chars", "source", "lang")


def sealed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all columns but OWN under names that no stage uses, and the names to give back by toDF."""
    return docs.toDF(*[c if c in OWN else f"sealed_{k}" for k, c in enumerate(docs.columns)]), docs.columns
