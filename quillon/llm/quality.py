"""Quality rules as a bitmask ledger.

`ledger` measures each text once and evaluates every rule once: bit i of `failed` is set where rule i fails, and the
measurements stay beside it. A policy is a versioned set of rules, so a verdict is one bitwise AND, another policy needs no
second look at the texts, and `ablate` tells from the masks alone what each rule of a policy decides.

Defined cases: a null, empty or blank text has zero measurements and fails only `too_few_words`; every row of the input
gives one row, with repeated or null ids as they are; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import cut_blocks
from quillon.llm.rows import sealed
from quillon.llm.words import BLANK, U, Words, mix, rolling, runs

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
BLOCK = 4 << 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_NEWLINE = np.arange(256) == 0x0A

#: Rules in the order of their bits: a name, and SQL that is true where a text fails.
RULES = (
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
)
#: Policies by version: the rules that reject.
POLICIES = {
    "v0": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def _totals(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[borders])


def _measure(block: pa.Table) -> pa.Table:
    words = Words(block.column("text"))
    n, size = len(words.count), len(words.data) - 8
    bytes_ = words.data[:size]
    salt = mix(np.arange(1, n + 1, dtype=U))
    inside = ~BLANK[bytes_] & ~_CONTINUES[bytes_]
    h = rolling(words.hashes(), 5)
    text = words.text
    at = np.flatnonzero(np.repeat(words.before[1:], words.count)[: len(h)] - np.arange(len(h)) >= 5)
    keys = h[at] ^ salt[text[at]]
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    often = np.repeat(np.diff(np.append(first, len(keys))) > 1, np.diff(np.append(first, len(keys))))
    cover = np.zeros(len(text) + 5, np.int32)
    twice = at[order[often]]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    repeated = np.cumsum(cover)[: len(text)] > 0
    lines = Words(block.column("text"), blank=_NEWLINE)
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_text = lines.text[filled]
    keys = np.unique(lines.hashes()[filled] ^ salt[line_text], return_index=True)[1]
    n_lines = np.bincount(line_text, minlength=n)
    return pa.table(
        {
            "doc_id": block.column("doc_id").cast(pa.int64()),
            "n_words": words.count.astype(np.int64),
            "word_chars": _totals(inside, words.offsets),
            "n_symbols": _totals(SYMBOLS[bytes_], words.offsets),
            "n_lines": n_lines,
            "n_dup_lines": n_lines - np.bincount(line_text[keys], minlength=n),
            "n_repeat_words": _totals(repeated, words.before),
        }
    )


def _task(batches):
    for block in cut_blocks(batches, "text", BLOCK):
        yield from _measure(block).to_batches()


def failed_mask(rules=RULES) -> Column:
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(rules)]
    return sum(bits[1:], bits[0]).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """Per row: the measurements and `failed`, the bits of the rules that it fails."""
    return docs.select("doc_id", "text").mapInArrow(_task, SCHEMA).withColumn("failed", failed_mask())


def judge(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds `kept`: no rule of the policy fails."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def apply(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns, whatever their names are."""
    docs, names = sealed(docs)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f.name, f.dataType) for f in T._parse_datatype_string(SCHEMA).fields[1:]]])

    def task(batches):
        for block in cut_blocks(batches, "text", BLOCK):
            measured = _measure(block)
            for name in measured.column_names[1:]:
                block = block.append_column(name, measured.column(name))
            yield from block.to_batches()

    kept = docs.mapInArrow(task, schema).where(failed_mask().bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)
    return kept.select(*docs.columns).toDF(*names)


def ablate(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects (kept if it were dropped). One pass that
    groups by the mask: at most 2**rules groups leave it."""
    whole = mask(POLICIES[policy])
    groups = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if whole >> i & 1]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        groups.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"))
    )
