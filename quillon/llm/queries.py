"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, oracles, quality, tokens
from quillon.llm.decontam import contaminated, decontaminate
from quillon.llm.lines import dedup_lines
from quillon.llm.lm import base_score, score_texts
from quillon.llm.neardup import near_duplicates
from quillon.llm.negatives import mine
from quillon.llm.pii import BASE as PII_BASE
from quillon.llm.pii import find_personal_data
from quillon.llm.secret_scan import KINDS as SECRET_KINDS
from quillon.llm.secret_scan import find_secrets
from quillon.llm.substrings import dedup_substrings
from quillon.llm.toxicity import score_toxicity
from quillon.llm.variants import spelling_variants
from quillon.shared import checkpoint_dir, cut, remove, table

#: Of the public tokenizers; op12's format takes any other path.
TOKENIZER = "byte_bpe_50k.json"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.col("n_train").alias("train_tokens"), F.round(base_score(), 6).alias("base_score"), F.round("score", 6).alias("score"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("too_few_words", "repeated_windows")
    out = quality.judge(quality.ledger(table(spark, sf_dir, "documents")))
    base_failed = F.col("failed").bitwiseAND(F.lit(quality.mask(base))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "n_lines", "failed")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _numbers(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    number = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return [number(k).alias(f"n_{k}") for k in kinds]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *_numbers(base, PII_BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_chars_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=mixing.KEEP)
    names = [F.col(f"mix_{d}").alias(d) for d in mixing.DIMENSIONS]
    return mixed.select("doc_id", *names, F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_prob", 6).alias("prob"), F.col("mix_kept").alias("kept"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), contaminated().alias("contaminated"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "other")
    return found.select("doc_id", *_numbers(base, SECRET_KINDS[:3]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid4().hex}"
    try:
        tokens.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
        return cut(tokens.digests(spark, folder))
    finally:
        remove(spark, folder)  # what was asked for has been read


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {name: oracles.SQL[name] for name in QUERIES if name in oracles.SQL}
