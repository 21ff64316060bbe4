"""The pipeline against its SQL and over odd rows; queries against their SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries
from quillon.shared import cut

DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def compare(df, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


@needs_tables
def test_run_equals_sql(spark):
    compare(corpus_pipeline.run(spark, DATA), corpus_pipeline.ORACLE_SQL)


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_answer_every_row(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert df.columns[0] == "doc_id"


def test_stages_carry_whole_rows(spark, rows, tmp_path):
    """Every stage keeps the values of all other columns of the rows it keeps, and never adds a row, whatever the columns are called."""
    from collections import Counter

    from conftest import STAGE_CLASHING

    spark.createDataFrame([(1, "w1 w2 w3"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in STAGE_CLASHING)
    data = [(d, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *[f"{c}{k}" for c in STAGE_CLASHING]) for k, (d, t) in enumerate(rows)]
    data += [data[0], data[0], data[-2]]
    docs = cut(spark.createDataFrame(data, schema).repartition(3))
    extra = lambda df, skip: Counter(tuple(r[len(df.columns) - skip - len(STAGE_CLASHING) : len(df.columns) - skip]) for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "source_mix"]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, str(tmp_path)))
        last = name == "source_mix"
        if last:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *[c + "_input" if c.startswith("mix_") else c for c in STAGE_CLASHING], "mix_tokens", "mix_weight", "mix_prob"]
        else:
            assert out.columns == docs.columns
        assert extra(out, 3 if last else 0) <= extra(docs, 0) and out.count() > 0, name


def test_near_dedup_removes_rows_in_the_pipeline(spark, tmp_path):
    """Near copies of one long line have no line in common, so line dedup leaves them; fragments that it leaves of others go with it."""
    import random

    r = random.Random(4)
    word = lambda: f"v{r.randrange(10**6)}"
    texts = {}
    for k in range(20):
        w = [word() for _ in range(200)]
        texts[k] = " ".join(w)
        w[17] = word()
        texts[100 + k] = " ".join(w)
    many = [" ".join(word() for _ in range(9)) for _ in range(12)]
    texts[50] = "\n".join(many)
    texts[51] = "\n".join([*many, "a few more words"])
    texts[52] = "\n".join([*many[:3], *[" ".join(word() for _ in range(9)) for _ in range(3)]])
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        left[name] = {x.doc_id for x in docs.collect()}
    assert left["quality_rules"] == set(texts)
    assert left["line_dedup"] == set(texts) - {51}
    assert left["near_dedup"] == left["decontaminate"] == {*range(20), 50, 52}


def test_stages_over_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
