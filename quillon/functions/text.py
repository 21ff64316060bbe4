"""Text, id, date and number functions as Column expressions; Arrow UDFs only where Unicode tables are needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns of paper ids.
NEW_ID = r"[0-9]{4}\.[0-9]{4,5}"
OLD_ID = r"[a-z\-]+(?:\.[A-Z]{2})?/[0-9]{7}"
#: Fixed translation of typographic dashes, signs and quotes.
DASHES = ("–—−×’“”", "---x'\"\"")


def normalize_ws(s: Column) -> Column:
    """Runs of Unicode white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_nul(s: Column) -> Column:
    return F.translate(s, "\x00", "")


@F.pandas_udf(StringType())
def author_norm(names: pd.Series) -> pd.Series:
    """Accents dropped, white space collapsed, case folded."""

    def one(name):
        if name is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join(plain.split()).casefold()

    return names.map(one, na_action="ignore")


def norm_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


#: A paper id, alone or with a prefix or in a link, with version and suffix.
PAPER_ID = rf"^(?:(?i:https?://)?(?i:(?:[a-z]+\.)?arxiv\.org)/(?:abs|pdf|html)/|(?i:arxiv:))?({NEW_ID}|{OLD_ID})(?:v[0-9]+)?(?:\.pdf)?/?$"


def parse_paper_id(s: Column) -> Column:
    """The paper id in an id, a prefixed id or a link, without version or suffix; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(s), PAPER_ID, 1), F.lit(""))


def split_version(s: Column) -> Column:
    """(id, version) at the last v; nulls where there is no version."""
    pattern = r"^(.+)v([0-9]+)$"
    return F.struct(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).alias("id"), F.regexp_extract(s, pattern, 2).try_cast("int").alias("version"))


def versioned_id(paper_id: Column, version: Column) -> Column:
    return F.concat(paper_id.cast("string"), F.lit("v"), version.cast("string"))


def parse_time(s: Column) -> Column:
    """RFC 3339 or a bare date, in UTC."""
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def display_name(forenames: Column, keyname: Column) -> Column:
    return F.nullif(F.concat_ws(" ", forenames, keyname), F.lit(""))


def doi_of(element: Column, link: Column) -> Column:
    """The DOI element, else the tail of a resolver link."""
    return F.coalesce(F.trim(element), F.nullif(F.regexp_extract(link, r"^.*doi\.org/(.+)$", 1), F.lit("")))


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def web_name(title: Column, query: Column) -> Column:
    """The query's first 48 characters, else a coined name before the title's colon, else its first six words."""
    title = normalize_ws(title)
    head = F.trim(F.substring_index(title, ":", 1))
    words = F.split(title, " ")
    first = F.concat(F.array_join(F.slice(words, 1, 6), " "), F.when(F.size(words) > 6, F.lit(" …")).otherwise(F.lit("")))
    asked = F.nullif(F.trim(query), F.lit(""))
    return F.when(asked.isNotNull(), F.substring(asked, 1, 48)).when((head != title) & F.length(head).between(2, 40), head).otherwise(first)


def identifiers(query: Column) -> Column:
    """Sorted distinct tokens with a digit or a capital behind the first character."""
    tokens = F.regexp_extract_all(query, F.lit(r"(?U)[\w.+-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"[0-9]") | t.rlike(r"(?U)^.+\p{Lu}"))))


def scope_key(k: Column, categories: Column, since: Column, query: Column) -> Column:
    """16 hex digits that name a search's filters and identifiers."""
    cats = F.array_join(F.array_sort(F.coalesce(categories, F.array().cast("array<string>"))), ",")
    return F.left(F.sha1(F.concat_ws("|", k.cast("string"), cats, F.coalesce(since.cast("string"), F.lit("")), F.array_join(identifiers(query), ","))), F.lit(16))


def similar_weight(sim: Column) -> Column:
    """A cosine of 0.6 to 0.8 as a weight of 0 to 1, at least 0.1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), (sim - 0.60) / 0.20))


def edge_key(paper_id: Column, other_id: Column, title: Column) -> Column:
    full = lambda c: c.isNotNull() & (c != "")
    return F.when(full(paper_id), F.concat(F.lit("arxiv:"), paper_id)).when(full(other_id), F.concat(F.lit("s2:"), other_id)).when(full(title), F.concat(F.lit("title:"), F.substring(norm_title(title), 1, 120)))


#: Fixed patterns of a year and of a quoted title.
YEAR = r"\b(?:19|20)[0-9]{2}\b"
QUOTED_TITLE = '[“"]([^”"]{8,300}?)[,.]?[”"]'


def last_year(s: Column) -> Column:
    found = F.regexp_extract_all(s, F.lit(YEAR), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def quoted_title(s: Column) -> Column:
    got = F.regexp_extract(s, QUOTED_TITLE, 1)
    return F.nullif(F.trim(F.regexp_replace(got, "^[ ,.]+|[ ,.]+$", "")), F.lit(""))


def passage(text: Column, section: Column) -> Column:
    """A chunk without its first line, where that repeats the section's title."""
    first = F.substring_index(text, "\n", 1)
    rest = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(F.lit(""))
    return F.when(F.trim(first) == F.trim(section), rest).otherwise(text)


def first_sentence(abstract: Column, least: int = 40, most: int = 300) -> Column:
    """Sentences are joined until `least` characters are reached, then cut at `most`."""
    parts = F.split(abstract, r"(?<=[.!?])\s+")
    joined = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(F.length(acc) >= least, acc).otherwise(F.trim(F.concat(acc, F.lit(" "), x))))
    return F.substring(joined, 1, most)


def title_name(title: Column) -> Column:
    """The coined name before a title's colon: one token of 2 to 20 characters with a capital or a digit behind its first."""
    return F.nullif(F.regexp_extract(title, r"^([A-Za-z0-9][A-Za-z0-9+.-]*[A-Z0-9][A-Za-z0-9+.-]{0,18}):\s", 1), F.lit(""))


def claim_norm(s: Column) -> Column:
    return normalize_ws(F.lower(F.translate(s, *DASHES)))


def numbers(s: Column) -> Column:
    """Canonical numbers of a text: decimal commas as points, trailing zeros and points dropped (also of whole numbers)."""
    found = F.regexp_extract_all(F.translate(s, *DASHES), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    canonical = lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(n, ",", "."), "0+$", ""), r"\.+$", "")
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.when(canonical(n) == "", F.lit("0")).otherwise(canonical(n)))))


def one_liner(text: Column) -> Column:
    """Up to the first sentence end."""
    return F.substring_index(text, ". ", 1)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a completion from prices a million tokens; null for an unknown price."""
    return ((tokens_in * price_in + tokens_out * price_out) / 1_000_000).cast("decimal(10,5)")


def model_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """cost by a price map of model: (in, out); null for a model that it lacks."""
    if not prices:
        return F.lit(None).cast("decimal(10,5)")
    of = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for m, p in sorted(prices.items()) for x in (m, float(p[k]))]), model)
    return cost(tokens_in, tokens_out, of(0), of(1))


def display_date(at: Column) -> Column:
    """Day, month and year, as "7 Feb 2024"."""
    return F.date_format(at, "d MMM yyyy")


def abstract_chunk(title: Column, abstract: Column) -> Column:
    body = F.concat(title, F.lit("\n\n"), abstract)
    return F.struct(F.lit(0).alias("idx"), F.lit("abstract").alias("section"), body.alias("text"), F.greatest(F.lit(1), F.size(F.filter(F.split(body, r"\s+"), lambda x: x != ""))).alias("token_count"))


def join_hyphens(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, "\r\x00", ""), r"(\w)-\n(\w)", "$1$2")


def reflow(s: Column) -> Column:
    """Paragraphs on blank lines, each on one line; empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(s, "\n\n"), normalize_ws), lambda p: p != ""), "\n\n")


def error_text(s: Column) -> Column:
    return F.left(s, F.lit(2000))
