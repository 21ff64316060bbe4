"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Built of DataFrame operations alone. Tokens are summed over cells of (source, language, topic); the cells' masses are
raked in turn to the target marginals of each dimension, so each pass multiplies a category's cells by target over
present mass. A cell's weight is its raked over its original mass, and its documents are kept with probability min(1, factor * weight),
the factor solved over the cells so that the expected tokens are the share `keep` of all tokens: a rare category cannot set the rate
of the others. Cells at 1 give less than their raked mass, and `marginals` reports what each category then lacks. Without `keep` the
probability is weight / largest weight: the largest sample whose expected token marginals are the raked ones, however small it is.
The draw is a hash of the document id.

A raking pass is a window over the cells, so the plan grows by one small exchange a pass, and the driver sees single totals
only; cells are pre-aggregated, hence a source with a third of all rows is a few rows here. The cells are joined back by broadcast only
if they are at most `BROADCAST_CELLS`, which is counted first; beyond that by a shuffled join that Spark splits where skewed.

Defined cases: a null source, language or topic is a category of its own, "(none)"; a null or blank text has no tokens, and a cell
without tokens has weight 0 and keeps nothing; rows that share an id share their draw; a null id draws by its text; an empty
table gives no rows; other columns are carried along, those with the name of an added one under `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.rows import sealed
from quillon.shared import cut

DIMENSIONS = ("source", "lang", "topic")
#: Columns that mix adds.
ADDED = (*(f"mix_{d}" for d in DIMENSIONS), "mix_tokens", "mix_weight", "mix_prob", "mix_kept")
#: Target of a category: its share of tokens to this power, normalised (1 keeps the shares, 0 makes them equal).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
PASSES = 8
#: Share of all tokens that the query and the pipeline's stage keep.
KEEP = 0.5
BROADCAST_CELLS = 50_000
WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 13  # hex digits of the draw: 52 bits, exact in a double


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: str = "text", tokens: str = "mix_tokens") -> Column:
    """A coarse topic from a text's form, for tables that have no topic column."""
    return (
        F.when(F.instr(F.col(text), " | ") > 0, "table")
        .when(F.col(text).rlike("[#*$%&<>]{3}"), "markup")
        .when(F.col(tokens) < 100, "note")
        .when(F.col(tokens) < 1000, "article")
        .otherwise("book")
    )


def input_names(columns: list[str]) -> list[str]:
    """Names under which input columns are carried on: one that is called as an added column becomes <name>_input."""
    out, taken = [], {*columns, *ADDED}
    for c in columns:
        name = c
        while name in ADDED or (name != c and name in taken):
            name += "_input"
        taken.add(name)
        out.append(name)
    return out


def measured(docs: DataFrame, topic_column: str | None = None) -> DataFrame:
    """docs with mix_tokens and the names of their cell. topic_column names a column of docs that holds the topic."""
    docs = docs.toDF(*input_names(docs.columns)).withColumn("mix_tokens", n_tokens())
    kind = F.col(topic_column) if topic_column else topic()
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return docs.withColumns({"mix_source": name(F.col("source")), "mix_lang": name(F.col("lang")), "mix_topic": name(kind)})


def rake(docs: DataFrame, powers: dict[str, float] | None = None, passes: int = PASSES) -> DataFrame:
    """Per cell of measured docs: tokens, documents, share (its part of all tokens), raked mass, and weight (raked / share)."""
    powers = POWERS | (powers or {})
    keys = [f"mix_{d}" for d in DIMENSIONS]
    cells = docs.groupBy(*keys).agg(F.sum("mix_tokens").cast("double").alias("tokens"), F.count("*").alias("documents"))
    cells = cut(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    cells = cells.withColumn("share", F.col("tokens") / F.lit(total or 1.0))
    by = {d: Window.partitionBy(f"mix_{d}") for d in DIMENSIONS}
    for d in DIMENSIONS:
        power = F.lit(powers[d])
        tempered = cells.groupBy(f"mix_{d}").agg(F.sum("share").alias("s")).where("s > 0").agg(F.sum(F.pow("s", power))).first()[0] or 1.0
        share = F.sum("share").over(by[d])
        cells = cells.withColumn(f"target_{d}", F.when(share > 0, F.pow(share, power) / F.lit(tempered)).otherwise(0.0))
    cells = cells.withColumn("mass", F.col("share"))
    for _ in range(passes):
        for d in DIMENSIONS:
            cells = cells.withColumn("mass", F.coalesce(F.try_divide(F.col("mass") * F.col(f"target_{d}"), F.sum("mass").over(by[d])), F.lit(0.0)))
    weight = F.coalesce(F.try_divide("mass", "share"), F.lit(0.0))
    return cells.select(*keys, "tokens", "documents", "share", *[f"target_{d}" for d in DIMENSIONS], "mass", weight.alias("weight"))


def draw() -> Column:
    """A number in [0, 1) from the document id (a null id: from the text)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def calibrated(cells: DataFrame, keep: float | None = None) -> DataFrame:
    """cells of rake with prob: weight / largest weight, or min(1, factor * weight) for an expected `keep` of all tokens.

    The factor rises from keep's share over the raked one and each round counts more cells as full, until none is added."""
    if keep is None:
        return cells.withColumn("prob", F.col("weight") / F.lit(cells.agg(F.max("weight")).first()[0] or 1.0))
    if not 0 < keep <= 1:
        raise ValueError(f"keep is a share of the tokens in (0, 1], not {keep}")
    factor, full = 0.0, -1
    while True:
        is_full = (F.col("weight") > 0) & (F.col("weight") * F.lit(factor) >= 1)
        own = cells.agg(F.sum("tokens"), F.sum(F.when(is_full, F.col("tokens"))), F.sum(F.when(~is_full, F.col("tokens") * F.col("weight"))), F.count(F.when(is_full, 1))).first()
        total, certain, rest, n = (x or 0.0 for x in own)
        if n == full or not rest:
            break
        factor, full = max(factor, (keep * total - certain) / rest), n
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)))


def marginals(cells: DataFrame) -> DataFrame:
    """Per dimension and category of calibrated cells: the target, the expected share of the kept tokens, and the tokens of cells kept whole."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("prob"))).first()[0] or 1.0
    kept = (F.sum(F.col("tokens") * F.col("prob")) / F.lit(total)).alias("expected")
    whole = F.coalesce(F.sum(F.when(F.col("prob") >= 1, F.col("tokens"))), F.lit(0.0)).alias("tokens_kept_whole")
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(f"mix_{d}").alias("category")).agg(F.max(f"target_{d}").alias("target"), kept, whole) for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix(docs: DataFrame, topic_column: str | None = None, powers: dict[str, float] | None = None, passes: int = PASSES, keep: float | None = None) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_prob and mix_kept. keep: the share of all tokens to keep (see calibrated)."""
    docs = measured(docs, topic_column)
    keys = [f"mix_{d}" for d in DIMENSIONS]
    cells = cut(rake(docs, powers, passes).select(*keys, "tokens", "weight"))
    n = cells.count()
    cells = calibrated(cells, keep).select(*keys, F.col("weight").alias("mix_weight"), F.col("prob").alias("mix_prob"))
    out = docs.join(F.broadcast(cells) if n <= BROADCAST_CELLS else cells, keys)
    return out.withColumn("mix_kept", draw() < F.col("mix_prob"))


def apply(docs: DataFrame, keep: float | None = KEEP) -> DataFrame:
    """The rows that the draw keeps for a share of the tokens, all columns whatever their names are (see input_names), with mix_tokens, mix_weight and mix_prob."""
    inner, names = sealed(docs)
    kept = mix(inner, keep=keep).where("mix_kept")
    out = kept.select(*inner.columns, "mix_tokens", F.round("mix_weight", 6), F.round("mix_prob", 6))
    return out.toDF(*input_names(names), "mix_tokens", "mix_weight", "mix_prob")


def oracle(passes: int = PASSES, powers: dict[str, float] = POWERS, keep: float = KEEP) -> str:
    """DuckDB SQL of the same mix over `documents`: with the cells in falling order of weight, the first one that is not full once all
    before it are tells the factor."""
    steps, last = [], "c0"
    for i in range(passes):
        for d in DIMENSIONS:
            now = f"p{i}_{d}"
            steps.append(f"{now} AS (SELECT * REPLACE (CASE WHEN sum(mass) OVER (PARTITION BY {d}) > 0 THEN mass * target_{d} / sum(mass) OVER (PARTITION BY {d}) ELSE 0.0 END AS mass) FROM {last})")
            last = now
    shares = ", ".join(f"sum(share) OVER (PARTITION BY {d}) AS share_{d}" for d in DIMENSIONS)
    norms = ", ".join(f"(SELECT sum(power(s, {powers[d]})) FROM (SELECT sum(share) AS s FROM c2 GROUP BY {d}) WHERE s > 0) AS norm_{d}" for d in DIMENSIONS)
    targets = ", ".join(f"CASE WHEN share_{d} > 0 THEN power(share_{d}, {powers[d]}) / norm_{d} ELSE 0.0 END AS target_{d}" for d in DIMENSIONS)
    return rf"""
WITH t AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n FROM documents),
d AS (
  SELECT doc_id, n, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#*$%&<>]{{3}}') THEN 'markup' WHEN n < 100 THEN 'note' WHEN n < 1000 THEN 'article' ELSE 'book' END AS topic FROM t),
c1 AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM d GROUP BY ALL),
c2 AS (SELECT *, coalesce(tokens / nullif(sum(tokens) OVER (), 0), 0.0) AS share FROM c1),
c3 AS (SELECT *, {shares} FROM c2),
c4 AS (SELECT *, {norms} FROM c3),
c0 AS (SELECT source, lang, topic, share, share AS mass, {targets} FROM c4),
{", ".join(steps)},
w AS (SELECT source, lang, topic, tokens, CASE WHEN share > 0 THEN mass / share ELSE 0.0 END AS weight FROM {last} JOIN c1 USING (source, lang, topic)),
g AS (SELECT weight, sum(tokens) AS t FROM w WHERE weight > 0 GROUP BY weight),
h AS (
  SELECT weight, {keep} * (SELECT sum(tokens) FROM w) - coalesce(sum(t) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    sum(t * weight) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g),
f AS (SELECT coalesce(max_by(open / rest, weight) FILTER (open / rest * weight < 1), min_by(open / rest, weight), 0.0) AS factor FROM h),
p AS (SELECT source, lang, topic, weight, least(1.0, weight * factor) AS prob FROM w, f)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n AS n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, {_DIGITS}))::BIGINT / {float(16**_DIGITS)!r} < prob AS kept
FROM d JOIN p USING (source, lang, topic)
"""
