"""Paper feeds: Atom pages and bulk-harvest records to paper rows, and the paged walk over a category."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.schema import PAPER, PAPER_NAMES

#: Fixed XML namespaces.
ATOM = "{http://www.w3.org/2005/Atom}"
ARXIV = "{http://arxiv.org/schemas/atom}"
SEARCH = "{http://a9.com/-/spec/opensearch/1.1/}"
OAI = "{http://www.openarchives.org/OAI/2.0/}"
META = "{http://arxiv.org/OAI/arXiv/}"


class BadEntry(ValueError):
    pass


def _text(node: ET.Element | None, name: str) -> str:
    found = None if node is None else node.find(name)
    return " ".join((found.text or "").split()) if found is not None else ""


def _time(s: str, what: str) -> str:
    try:
        at = datetime.fromisoformat(s)
    except ValueError as error:
        raise BadEntry(f"{what}: {error}") from error
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def atom_entry(entry: ET.Element, polled_at: str) -> dict | None:
    """A paper message of an entry; None for an entry that is no paper; BadEntry if it can't be read."""
    link = _text(entry, f"{ATOM}id")
    if "/abs/" not in link:
        return None
    name = link.rsplit("/abs/", 1)[1]
    own, _, version = name.rpartition("v")
    if not own or not version.isdigit():
        raise BadEntry(f"{name}: no version")
    title, abstract = _text(entry, f"{ATOM}title"), _text(entry, f"{ATOM}summary")
    if not title or not abstract:
        raise BadEntry(f"{name}: no title or abstract")
    categories = [c.get("term") for c in entry.findall(f"{ATOM}category") if c.get("term")]
    first = entry.find(f"{ARXIV}primary_category")
    primary = (first.get("term") if first is not None else None) or (categories[0] if categories else None)
    if not primary:
        raise BadEntry(f"{name}: no category")
    links = {n.get("title"): n.get("href") for n in entry.findall(f"{ATOM}link") if n.get("title") and n.get("href")}
    resolver = links.get("doi", "")
    doi = _text(entry, f"{ARXIV}doi") or (resolver.rsplit("doi.org/", 1)[1] if "doi.org/" in resolver else "")
    return {
        "schema_version": 1,
        "arxiv_id": own,
        "version": int(version),
        "title": title,
        "abstract": abstract,
        "authors": [x for x in (_text(a, f"{ATOM}name") for a in entry.findall(f"{ATOM}author")) if x],
        "primary_category": primary,
        "categories": categories if primary in categories else [primary, *categories],
        "published_at": _time(_text(entry, f"{ATOM}published"), name),
        "updated_at": _time(_text(entry, f"{ATOM}updated"), name),
        "pdf_url": links.get("pdf", f"https://arxiv.org/pdf/{name}").replace("http://", "https://", 1),
        "html_url": f"https://arxiv.org/html/{name}",
        "doi": doi or None,
        "journal_ref": _text(entry, f"{ARXIV}journal_ref") or None,
        "comment": _text(entry, f"{ARXIV}comment") or None,
        "polled_at": polled_at,
    }


def parse_atom(xml: str, polled_at: str) -> tuple[int, list[dict], list[str]]:
    """(total results, papers, errors of entries that were dropped)."""
    feed = ET.fromstring(xml)
    if feed.tag != f"{ATOM}feed":
        raise ValueError(f"unexpected root element {feed.tag}")
    total = _text(feed, f"{SEARCH}totalResults")
    papers, errors = [], []
    for entry in feed.findall(f"{ATOM}entry"):
        try:
            row = atom_entry(entry, polled_at)
        except BadEntry as error:
            errors.append(str(error))
            continue
        if row:
            papers.append(row)
    return int(total) if total.isdigit() else 0, papers, errors


def parse_harvest(xml: str, polled_at: str) -> tuple[list[dict], str | None]:
    """(papers, resumption token) of a bulk-harvest response: ids have no version there, so it is 1."""
    root, papers = ET.fromstring(xml), []
    for record in root.iter(f"{OAI}record"):
        meta = record.find(f"{OAI}metadata/{META}arXiv")
        own, title, abstract = (_text(meta, f"{META}{x}") for x in ("id", "title", "abstract"))
        categories = _text(meta, f"{META}categories").split()
        if meta is None or not (own and title and abstract and categories):
            continue
        names = [f"{_text(a, f'{META}forenames')} {_text(a, f'{META}keyname')}".strip() for a in meta.findall(f"{META}authors/{META}author")]
        created = _text(meta, f"{META}created") or polled_at[:10]
        papers.append(
            {
                "schema_version": 1,
                "arxiv_id": own,
                "version": 1,
                "title": title,
                "abstract": abstract,
                "authors": [n for n in names if n],
                "primary_category": categories[0],
                "categories": categories,
                "published_at": _time(created, own),
                "updated_at": _time(_text(meta, f"{META}updated") or created, own),
                "pdf_url": f"https://arxiv.org/pdf/{own}",
                "html_url": f"https://arxiv.org/html/{own}",
                "doi": _text(meta, f"{META}doi") or None,
                "journal_ref": _text(meta, f"{META}journal-ref") or None,
                "comment": _text(meta, f"{META}comments") or None,
                "polled_at": polled_at,
            }
        )
    token = next((t.text for t in root.iter(f"{OAI}resumptionToken") if t.text), None)
    return papers, token


def papers_of_pages(pages: DataFrame, kind: str = "atom") -> DataFrame:
    """Paper rows of raw pages (xml, polled_at string); kind is atom or harvest. A page that is no XML gives no rows."""
    names = list(PAPER_NAMES)

    def task(batches):
        for batch in batches:
            rows: list[dict] = []
            for xml, at in zip(batch.column("xml").to_pylist(), batch.column("polled_at").to_pylist()):
                try:
                    rows += parse_atom(xml, at)[1] if kind == "atom" else parse_harvest(xml, at)[0]
                except (ET.ParseError, ValueError, TypeError):
                    continue
            types = {n: pa.list_(pa.string()) if n in ("authors", "categories") else pa.int32() if n in ("schema_version", "version") else pa.string() for n in names}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)

    return pages.select("xml", "polled_at").mapInArrow(task, PAPER)


def in_categories(papers: DataFrame, wanted: list[str]) -> DataFrame:
    return papers.where(F.arrays_overlap("categories", F.array(*map(F.lit, wanted))))


def unseen(papers: DataFrame, seen: DataFrame) -> DataFrame:
    """Papers whose id and version are not in the seen set (member)."""
    return papers.withColumn("member", T.versioned_id(F.col("arxiv_id"), F.col("version"))).join(seen.select("member"), "member", "left_anti")


def walk(pages: DataFrame, cap: int = 10) -> DataFrame:
    """Pages (category, page, fetched, new) that a walk reads: up to and with the first page without new rows, at most `cap`."""
    order = Window.partitionBy("category").orderBy("page")
    before = F.min("new").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("before", before).where((F.col("page") <= cap) & (F.col("before").isNull() | (F.col("before") > 0))).drop("before")
