"""Outside services behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_BATCH, INTRO_CHARS, PDF_LIMIT, RETRIES, BACKOFF = 64, 6000, 20 << 20, 3, (5, 15, 45)


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class Summarizer(Protocol):
    def __call__(self, title: str, abstract: str, intro: str) -> str: ...


class HashEmbedder:
    """Signed hashes of words: like texts get like vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class LeadSummarizer:
    """The abstract's first sentence."""

    def __call__(self, title: str, abstract: str, intro: str) -> str:
        return (abstract or title).split(". ")[0]


def ordered(answer: Iterable[dict], n: int, dim: int) -> list[list[float]]:
    """Vectors of an embedding service's answer ({index, embedding}) in the order of the request, unit length; count and dimension are
    checked."""
    rows = sorted(answer, key=lambda r: r["index"])
    if len(rows) != n:
        raise ValueError(f"{len(rows)} vectors for {n} texts")
    out = []
    for row in rows:
        if len(row["embedding"]) != dim:
            raise ValueError(f"a vector of {len(row['embedding'])} dimensions, not {dim}")
        out.append(unit(row["embedding"]))
    return out


def unit(v: Sequence[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in v))
    return [float(x) / norm for x in v] if norm else [float(x) for x in v]


def embed(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """rows with `embedding`: the service is called with at most 64 texts at a time, in the tasks."""
    fields = rows.schema

    def task(batches):
        for batch in batches:
            texts, vectors = batch.column(text).to_pylist(), []
            for a in range(0, len(texts), EMBED_BATCH):
                got = embedder([t or "" for t in texts[a : a + EMBED_BATCH]])
                vectors += ordered([{"index": i, "embedding": v} for i, v in enumerate(got)], len(texts[a : a + EMBED_BATCH]), embedder.dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    from pyspark.sql import types as T

    return rows.mapInArrow(task, T.StructType([*fields.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def embed_each(rows: DataFrame, embedder: Embedder, text: str = "text", key: str = "paper_id", attempts: str = "attempts") -> DataFrame:
    """embed, with the failures as rows: (.., embedding, error, passing); passing says that another attempt may mend it.

    Rows without attempts so far share calls: a passing failure is one of the whole call, any other is sought by asking for each text
    alone. Rows with attempts are called paper by paper, so a text that never succeeds takes no other paper with it."""
    from pyspark.sql import types as T

    def asked(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None, None) for v in ordered([{"index": i, "embedding": v} for i, v in enumerate(embedder(texts))], len(texts), embedder.dim)]
        except Exception as error:  # noqa: BLE001 - the row is routed to the retry log or the dead letters
            if len(texts) > 1 and not isinstance(error, Transient):
                return [x for t in texts for x in asked([t])]
            return [(None, f"{type(error).__name__}: {error}", isinstance(error, Transient))] * len(texts)

    def calls(keys: list, before: list) -> Iterator[list[int]]:
        shared = [i for i, n in enumerate(before) if not n]
        yield from (shared[a : a + EMBED_BATCH] for a in range(0, len(shared), EMBED_BATCH))
        alone: dict = {}
        for i, n in enumerate(before):
            if n:
                alone.setdefault(keys[i], []).append(i)
        for own in alone.values():
            yield from (own[a : a + EMBED_BATCH] for a in range(0, len(own), EMBED_BATCH))

    def task(batches):
        for batch in batches:
            texts, out = batch.column(text).to_pylist(), [(None, None, None)] * batch.num_rows
            for own in calls(batch.column(key).to_pylist(), batch.column(attempts).to_pylist()):
                for i, x in zip(own, asked([texts[i] or "" for i in own])):
                    out[i] = x
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.list_(pa.float32()), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "embedding", "error", "passing"])

    more = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()), T.StructField("passing", T.BooleanType())]
    return rows.mapInArrow(task, T.StructType([*rows.schema.fields, *more]))


def summarize(papers: DataFrame, chunks: DataFrame, summarizer: Summarizer) -> DataFrame:
    """(paper_id, summary, error): of title, abstract and the first 6,000 characters of the introduction; a blank answer is an error."""
    intro = chunks.where(F.lower("section").contains("intro")).groupBy("paper_id").agg(F.min_by("text", "idx").alias("intro"))
    rows = papers.select("paper_id", "title", "abstract").join(intro, "paper_id", "left").withColumn("intro", F.left(F.coalesce("intro", F.lit("")), F.lit(INTRO_CHARS)))
    kind = dict(rows.dtypes)["paper_id"]

    def task(batches):
        for batch in batches:
            summaries, errors = [], []
            for title, abstract, text in zip(*(batch.column(c).to_pylist() for c in ("title", "abstract", "intro"))):
                value, error, _ = attempt(lambda: summarizer(title or "", abstract or "", text or ""), 1)  # noqa: B023
                blank = error is None and not (value or "").strip()
                summaries.append(None if blank or error else value)
                errors.append("blank summary" if blank else error)
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), pa.array(summaries, pa.string()), pa.array(errors, pa.string())], ["paper_id", "summary", "error"])

    return rows.mapInArrow(task, f"paper_id {kind}, summary string, error string")


class Transient(Exception):
    """A failure that another attempt may mend."""


def attempt(call: Callable[[], object], tries: int = RETRIES, pause: Callable[[int], None] | None = None) -> tuple[object, str | None, int]:
    """(value, error, attempts): transient failures are tried again, others are not; pause(n) waits behind the n-th failure."""
    for n in range(1, tries + 1):
        try:
            return call(), None, n
        except Transient as error:
            text = f"{type(error).__name__}: {error}"
            if n < tries and pause:
                pause(n)
        except Exception as error:  # noqa: BLE001 - the row is routed to the dead letters
            return None, f"{type(error).__name__}: {error}", n
    return None, text, tries


def retryable(status: int) -> bool:
    return status == 429 or status >= 500


def html_status(pages: DataFrame, marker: str = "ltx_document") -> DataFrame:
    """(.., status, body) of fetched pages (http, html): done, none (absent, or of another page family), failed."""
    done = (F.col("http") == 200) & F.coalesce(F.col("html").contains(marker), F.lit(False))
    return pages.withColumn("status", F.when(done, "done").when(F.col("http").isin(200, 404), "none").otherwise("failed")).withColumn("body", F.when(done, F.col("html")))


def valid_pdfs(files: DataFrame, limit: int = PDF_LIMIT) -> DataFrame:
    """Rows of Spark's binaryFile source that are PDFs within the size limit; the length is tested before the content is read."""
    return files.where((F.col("length") <= limit) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))


def pdf_texts(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) of PDF files: `convert` wraps an outside tool and is called in the tasks; it raises on a timeout."""

    def task(batches):
        for batch in batches:
            texts, errors = [], []
            for content in batch.column("content").to_pylist():
                value, error, _ = attempt(lambda: convert(content or b""), 1)  # noqa: B023
                texts.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return valid_pdfs(files).select("path", "content").mapInArrow(task, "path string, text string, error string")


def citation_records(papers: DataFrame, fetch: Callable[[list[str]], list[dict | None]], batch_size: int = 500, pause: Callable[[int], None] | None = None) -> DataFrame:
    """(paper_id, record json, error): at most `batch_size` ids a call, answers aligned with the ids (a miss is null). A busy service is tried
    again after each of BACKOFF; `pause` gets the number of the try."""
    ids = papers.select(F.col("paper_id").cast("string").alias("paper_id"))

    def task(batches):
        for batch in batches:
            own = batch.column("paper_id").to_pylist()
            records, errors = [], []
            for a in range(0, len(own), batch_size):
                part = own[a : a + batch_size]
                got, error, _ = attempt(lambda: _aligned(fetch(part), len(part)), len(BACKOFF) + 1, pause)  # noqa: B023
                records += [json.dumps(r) if r else None for r in got] if error is None else [None] * len(part)
                errors += [error] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), pa.array(records, pa.string()), pa.array(errors, pa.string())], ["paper_id", "record", "error"])

    return ids.mapInArrow(task, "paper_id string, record string, error string")


def _aligned(answer: list, n: int) -> list:
    if len(answer) != n:
        raise ValueError(f"{len(answer)} records for {n} ids")
    return answer


#: Python types of the JSON types that a schema may name.
_JSON = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def schema_error(value: object, schema: dict, at: str = "answer") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties, additionalProperties, items, minItems, maxItems), or None."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _JSON[k]) and not (k in ("integer", "number") and isinstance(value, bool)) for k in kinds):
        return f"{at} is not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at} is not one of {schema['enum']}"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name} is missing"
        for name, part in value.items():
            if name not in own:
                if schema.get("additionalProperties") is False:
                    return f"{at}.{name} is not expected"
            elif found := schema_error(part, own[name], f"{at}.{name}"):
                return found
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at} has {len(value)} items"
        for k, part in enumerate(value):
            if "items" in schema and (found := schema_error(part, schema["items"], f"{at}[{k}]")):
                return found
    return None


def complete_json(call: Callable[[int], dict], required: Sequence[str], tries: int = 2, schema: dict | None = None) -> dict:
    """A JSON object with the required keys that keeps to the schema: a truncated answer is an error, one retry."""
    error = ""
    schema = {"type": "object", "required": list(required)} | (schema or {})
    for n in range(tries):
        answer = call(n)
        if answer.get("finish_reason") == "length":
            raise ValueError("the answer was cut off")
        try:
            value = json.loads(answer["content"])
            error = schema_error(value, schema)
            if error is None:
                return value
        except ValueError as problem:
            error = str(problem)
    raise ValueError(f"no valid answer: {error}")
