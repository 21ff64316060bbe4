"""Table and message schemas, and the first violation of a message as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed message contracts, version 1: field name and type in the order of their checks.
PAPER_FIELDS = (
    ("schema_version", "int"),
    ("arxiv_id", "string"),
    ("version", "int"),
    ("title", "string"),
    ("abstract", "string"),
    ("authors", "array<string>"),
    ("primary_category", "string"),
    ("categories", "array<string>"),
    ("published_at", "string"),
    ("updated_at", "string"),
    ("pdf_url", "string"),
    ("html_url", "string"),
    ("doi", "string"),
    ("journal_ref", "string"),
    ("comment", "string"),
    ("polled_at", "string"),
)
OPTIONAL = ("html_url", "doi", "journal_ref", "comment")
ID_PATTERN = r"^([0-9]{4}\.[0-9]{4,5}|[a-z\-]+(\.[A-Z]{2})?/[0-9]{7})$"
CHUNK = "struct<idx:int,section:string,text:string,token_count:int>"
PAPER = ", ".join(f"{n} {t}" for n, t in PAPER_FIELDS)
PAPER_NAMES = tuple(n for n, _ in PAPER_FIELDS)
CHUNKED = f"schema_version int, paper struct<{','.join(f'{n}:{t}' for n, t in PAPER_FIELDS)}>, source string, chunks array<{CHUNK}>, fetched_at string"
FAILED_FIELDS = (("schema_version", "int"), ("arxiv_id", "string"), ("stage", "string"), ("error", "string"), ("attempts", "int"), ("failed_at", "string"), ("payload", "string"))
FAILED = ", ".join(f"{n} {t}" for n, t in FAILED_FIELDS)

PAPERS_TABLE = (
    "paper_id string, version int, title string, abstract string, primary_category string, categories array<string>, published_at timestamp, updated_at timestamp, "
    "pdf_url string, html_url string, doi string, journal_ref string, comment string, source string, summary string, summary_model string, ingested_at timestamp, processed_at timestamp"
)
CHUNKS_TABLE = "paper_id string, idx int, section string, text string, token_count int, embedding array<float>"


def names(ddl: str) -> list[str]:
    """Column names of a flat table schema."""
    return [x.split()[0] for x in ddl.split(", ")]


def _first(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def _unknown_fields(raw: Column, known: list[str]) -> tuple[Column, str]:
    extra = F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    return F.size(extra) > 0, "unexpected field"


def _paper_checks(p: Column, at: str = "") -> list[tuple[Column, str]]:
    checks = [(p[name].isNull(), f"{at}{name} is missing or of another type") for name, _ in PAPER_FIELDS if name not in OPTIONAL]
    empty = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull() | (x == "")), F.lit(False))
    time = lambda c: F.try_to_timestamp(c).isNull() | ~c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]")
    checks += [
        (p["schema_version"] != 1, f"{at}schema_version is not 1"),
        (~p["arxiv_id"].rlike(ID_PATTERN), f"{at}arxiv_id does not match"),
        (p["version"] < 1, f"{at}version is under 1"),
        (p["title"] == "", f"{at}title is empty"),
        (p["abstract"] == "", f"{at}abstract is empty"),
        (empty(p["authors"]), f"{at}authors has an empty name"),
        (p["primary_category"] == "", f"{at}primary_category is empty"),
        ((F.size(p["categories"]) == 0) | empty(p["categories"]), f"{at}categories is empty"),
    ]
    checks += [(time(p[c]), f"{at}{c} is no date-time") for c in ("published_at", "updated_at", "polled_at")]
    return [*checks, (~p["pdf_url"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), f"{at}pdf_url is no URI")]


def paper_violation(raw: Column) -> Column:
    """The first violation of a paper message (JSON text), or null."""
    p = F.from_json(raw, PAPER)
    return _first([(p.isNull() | F.json_object_keys(raw).isNull(), "not a JSON object"), _unknown_fields(raw, list(PAPER_NAMES)), *_paper_checks(p)])


def chunked_violation(raw: Column) -> Column:
    """The first violation of a full-text message, or null."""
    m = F.from_json(raw, CHUNKED)
    chunk = F.exists(m["chunks"], lambda c: c["idx"].isNull() | (c["idx"] < 0) | c["text"].isNull() | (c["text"] == "") | c["token_count"].isNull() | (c["token_count"] < 1))
    own = [
        (F.json_object_keys(raw).isNull(), "not a JSON object"),
        _unknown_fields(raw, ["schema_version", "paper", "source", "chunks", "fetched_at"]),
        (F.coalesce(m["schema_version"] != 1, F.lit(True)), "schema_version is not 1"),
        (m["paper"].isNull(), "paper is missing"),
        *_paper_checks(m["paper"], "paper."),
        (F.coalesce(~m["source"].isin("html", "pdf", "abstract"), F.lit(True)), "source is not one of html, pdf, abstract"),
        (F.coalesce(F.size(m["chunks"]) < 1, F.lit(True)), "chunks is empty"),
        (chunk, "a chunk is not valid"),
        (F.try_to_timestamp(m["fetched_at"]).isNull(), "fetched_at is no date-time"),
    ]
    return _first(own)


def failed_violation(raw: Column) -> Column:
    m = F.from_json(raw, FAILED)
    checks = [(m[n].isNull(), f"{n} is missing or of another type") for n, _ in FAILED_FIELDS]
    return _first([(F.json_object_keys(raw).isNull(), "not a JSON object"), _unknown_fields(raw, [n for n, _ in FAILED_FIELDS]), *checks, (~m["stage"].isin("fetcher", "worker"), "stage is not one of fetcher, worker"), (m["attempts"] < 1, "attempts is under 1")])


def violation(kind: Column, raw: Column) -> Column:
    """By kind: paper, chunked or failed."""
    return F.when(kind == "paper", paper_violation(raw)).when(kind == "chunked", chunked_violation(raw)).when(kind == "failed", failed_violation(raw)).otherwise(F.lit("unknown kind"))


