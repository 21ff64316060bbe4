"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, source mixing.

STAGES are applied to `documents` one after the other; each stage works on what its predecessor kept and its decisions
take effect: rejected documents go, later copies of lines are cut from the texts (n_chars follows), one document of each
near-duplicate group stays, contaminated documents go, and the last stage samples to the target mix and adds each
document's tokens, weight and probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, lines, mixing, neardup, oracles, quality
from quillon.shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.apply(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.apply(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

ORACLE_SQL = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
