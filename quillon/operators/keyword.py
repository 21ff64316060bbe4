"""Keyword search: postings of lexemes with positions and weights, a web-search query grammar, and cover-density rank."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stem import STOP_WORDS, lexemes, stem
from quillon.shared import cut

CANDIDATES = 50
#: Distinct (query, term) pairs up to which they are broadcast; their number is counted first.
BROADCAST_TERMS = 200_000
#: Weight of a title (A) and an abstract (B) position.
WEIGHTS = {"A": 1.0, "B": 0.4}
TOKEN = r"[^a-z0-9]+"


def exact_tokens() -> Column:
    return F.array_remove(F.split(F.lower(F.concat_ws(" ", "title", "abstract")), TOKEN), "")


def exact_postings(papers: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, paper_id, tf, length): exact lower-case tokens of title and abstract, without stemming; of the terms of a table (term) alone if given."""
    # the length is made below the explode: above it, it would be made again for each token
    rows = papers.select("paper_id", exact_tokens().alias("tokens")).select("paper_id", F.size("tokens").cast("long").alias("length"), "tokens")
    # explode() would add a test for empty arrays that splits the text once more
    rows = rows.select("paper_id", "length", F.explode_outer("tokens").alias("term")).where("term is not null")
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("term", "paper_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def exact_search(queries: DataFrame, postings: DataFrame | None, papers: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, paper_id, kscore, krank) of papers that hold every term of a query (query_id, text).

    Without stored postings the papers are read once for the whole set (`scan`), and nothing but each task's best rows is shuffled. Stored
    postings are for a few queries: each posting of an asked term is shuffled once for each query that asks it. Terms meet them by
    broadcast where there are at most BROADCAST_TERMS, else by a shuffled join."""
    terms = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), TOKEN), lambda t: t != ""))).alias("term"))
    if postings is None:
        from quillon.operators import scan

        return scan.exact(terms, papers, limit)
    terms = cut(terms.withColumn("needed", F.count("*").over(Window.partitionBy("query_id"))))
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    hits = postings.join(small(terms), "term").groupBy("query_id", "paper_id").agg(F.count("*").alias("found"), F.first("needed").alias("needed"), F.round(F.sum("tf") / (1 + F.log(F.first("length").cast("double"))), 6).alias("kscore"))
    hits = hits.where("found = needed").join(papers.select("paper_id", "published_at"), "paper_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("kscore"), F.desc("published_at"), "paper_id")
    return hits.withColumn("krank", F.row_number().over(order)).where(F.col("krank") <= limit).select("query_id", "paper_id", "kscore", "krank")


def write_order(post: DataFrame) -> DataFrame:
    """Exact postings as they are stored: ordered by term, so a reader of some terms skips most files and row groups."""
    return post.repartitionByRange("term").sortWithinPartitions("term", "paper_id")


ENGLISH, SIMPLE = "english", "simple"
#: Of the stored position postings: a change of their form is another table.
VERSION = 1
_STEMMED = "paper_id long, titled int, lexemes array<string>"


def lexed(lexer: str) -> list[Column]:
    """(titled, lexemes): the tokens of title and abstract in order, not yet stemmed, the first `titled` of the title.
    simple: ASCII letters and digits, lower-cased. english: letters and digits of any script."""
    sign = TOKEN if lexer == SIMPLE else r"[^\p{L}\p{N}]+"
    tokens = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), sign), "")
    return [F.size(tokens("title")).alias("titled"), F.concat(tokens("title"), tokens("abstract")).alias("lexemes")]


def _lexemes(texts: DataFrame, lexer: str) -> DataFrame:
    """(paper_id, titled, lexemes): a stop word is null, english words are stemmed, each distinct word of a batch once."""
    rows = texts.select(F.col("paper_id").cast("long").alias("paper_id"), *lexed(lexer))
    if lexer == SIMPLE:
        return rows

    def task(batches):
        for batch in batches:
            lists = batch.column("lexemes")
            words = pc.dictionary_encode(lists.flatten())
            stems = pa.array([None if w in STOP_WORDS else stem(w) for w in words.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), batch.column("titled"), pa.ListArray.from_arrays(lists.offsets, stems.take(words.indices))], ["paper_id", "titled", "lexemes"])

    return rows.mapInArrow(task, _STEMMED)


def position_postings(papers: DataFrame, lexer: str = ENGLISH) -> DataFrame:
    """(term, paper_id, positions, titled, length): where each lexeme stands, from 0, positions under `titled` in the title."""
    rows = _lexemes(papers, lexer).select("paper_id", "titled", F.size("lexemes").alias("length"), F.posexplode("lexemes").alias("position", "term")).where("term is not null")
    own = rows.groupBy("term", "paper_id").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("titled").alias("titled"), F.first("length").alias("length"))
    return own.select("term", "paper_id", "positions", "titled", "length")


postings = position_postings


# -- query grammar ---------------------------------------------------------------------------------

_PIECE = re.compile(r'(-?)(?:"([^"]*)"|([^\s"]+))')


Phrase = tuple[tuple[str, int], ...]


def parse(query: str, lexer: str = ENGLISH) -> list[list[tuple[bool, Phrase]]]:
    """Alternatives ("or") of conjunctions of (negated, phrase): words are joined by AND, quotes make a phrase, - negates. A phrase is its
    lexemes with their distance from the first; stop words inside it keep their places."""
    groups: list[list] = [[]]
    for minus, quoted, word in _PIECE.findall(query):
        if not minus and word.lower() == "or":
            if groups[-1]:
                groups.append([])
            continue
        piece = quoted or word
        terms = lexemes(piece) if lexer == ENGLISH else [(t, k) for k, t in enumerate(x for x in re.split(TOKEN, piece.lower()) if x)]
        if terms:
            groups[-1].append((bool(minus), tuple((t, p - terms[0][1]) for t, p in terms)))
    return [g for g in groups if g]


_PARSED = "query_id long, alternative int, phrase int, negated boolean, slot int, distance int, term string, slots int, wanted int"


def parsed(queries: DataFrame, lexer: str = ENGLISH) -> DataFrame:
    """_PARSED rows of queries (query_id, text): a row a lexeme. slots: lexemes of its phrase; wanted: phrases of its alternative
    that are not negated. Alternatives that want nothing match nothing and give no rows."""

    def task(batches):
        for batch in batches:
            out = []
            for query, text in zip(batch.column("query_id").to_pylist(), batch.column("text").to_pylist()):
                for k, group in enumerate(parse(text or "", lexer)):
                    wanted = sum(not minus for minus, _ in group)
                    for n, (minus, phrase) in enumerate(group if wanted else ()):
                        out += [(query, k, n, minus, slot, distance, term, len(phrase), wanted) for slot, (term, distance) in enumerate(phrase)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row)) for row in out], _ARROW)

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(task, _PARSED)


_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[k]) for n, k in (x.split() for x in _PARSED.split(", "))])
_NAMES = _ARROW.names


def _starts(found: Column, distance: Column) -> Column:
    """Where a phrase begins: the places that all its lexemes agree on, each led back by its distance."""
    led = F.transform(found, lambda x: F.transform(x["positions"], lambda p: p - x["distance"]))
    return F.aggregate(F.slice(led, 2, F.size(led)), F.element_at(led, 1), lambda a, x: F.array_intersect(a, x))


_SPOT = "struct<first:int,last:int,phrase:int,weight:double>"


def _spots(found: Column, phrase: Column, titled: Column) -> Column:
    """The places of a phrase (a struct of its number and lexemes found) as structs _SPOT, with the mean weight of its lexemes."""
    own = F.filter(found, lambda x: x["phrase"] == phrase)
    weight = lambda at: F.aggregate(own, F.lit(0.0), lambda s, x: s + F.when(at + x["distance"] < titled, WEIGHTS["A"]).otherwise(WEIGHTS["B"])) / F.size(own)
    far = F.array_max(F.transform(own, lambda x: x["distance"]))
    return F.transform(_starts(own, far), lambda p: F.struct(p.alias("first"), (p + far).alias("last"), phrase.alias("phrase"), weight(p).alias("weight")).cast(_SPOT))


def _cover_density(spots: Column, wanted: Column, length: Column) -> Column:
    """A sweep over the sorted places: the latest place of each phrase makes a cover; covers that begin later than the last counted one
    add their mean weight over one more than their spare words."""
    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(-1).alias("phrase"), F.lit(0.0).alias("weight")).cast(_SPOT)
    state = "struct<latest:array<" + _SPOT + ">,begun:int,total:double>"

    def step(s: Column, x: Column) -> Column:
        others = F.filter(s["latest"], lambda y: y["phrase"] != x["phrase"])
        latest = F.concat(others, F.array(x))
        first, last = F.array_min(F.transform(latest, lambda y: y["first"])), F.array_max(F.transform(latest, lambda y: y["last"]))
        spare = F.when(last - first >= wanted, last - first - (wanted - 1)).otherwise(0)
        value = F.aggregate(latest, F.lit(0.0), lambda a, y: a + y["weight"]) / wanted / (1 + spare)
        counts = (F.size(latest) == wanted) & (first > s["begun"])
        return F.struct(latest.alias("latest"), F.when(counts, first).otherwise(s["begun"]).alias("begun"), (s["total"] + F.when(counts, value).otherwise(0.0)).alias("total")).cast(state)

    start = F.struct(F.filter(F.array(none), lambda y: y["first"] >= 0).alias("latest"), F.lit(-1).alias("begun"), F.lit(0.0).alias("total")).cast(state)
    return F.aggregate(F.array_sort(spots), start, step, lambda s: s["total"]) / (1 + F.log(F.greatest(length, F.lit(1)).cast("double")))


def match_queries(queries: DataFrame, postings: DataFrame, lexer: str = ENGLISH) -> DataFrame:
    """(query_id, paper_id, rank) of every paper that a web-search query (query_id, text) matches, by cover density to six digits.

    Queries are parsed in the tasks; their lexemes meet the postings (by broadcast where there are at most BROADCAST_TERMS, else by a
    shuffled join), a paper's postings for one alternative meet in one row, and papers that lack a lexeme the alternative wants leave
    before any position is looked at. Phrases, negation and rank are expressions over that row, which is no larger than the
    paper's own text times the alternative's lexemes."""
    terms = cut(parsed(queries, lexer))
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    hits = postings.join(small(terms), "term")
    lexeme = F.struct("phrase", "negated", "slot", "slots", "distance", "positions")
    wanted_lexemes = terms.where(~F.col("negated")).groupBy("query_id", "alternative").agg(F.count("*").alias("lexemes"))
    rows = hits.groupBy("query_id", "alternative", "paper_id").agg(F.collect_list(lexeme).alias("found"), F.count_if(~F.col("negated")).alias("held"), F.first("wanted").alias("wanted"), F.first("titled").alias("titled"), F.first("length").alias("length"))
    rows = rows.join(small(wanted_lexemes), ["query_id", "alternative"]).where(F.col("held") == F.col("lexemes"))
    numbers = lambda negated: F.array_distinct(F.transform(F.filter("found", lambda x: x["negated"] == F.lit(negated)), lambda x: x["phrase"]))
    whole = F.filter(numbers(True), lambda k: F.size(F.filter("found", lambda x: x["phrase"] == k)) == F.element_at(F.filter("found", lambda x: x["phrase"] == k), 1)["slots"])
    rows = rows.withColumn("spots", F.transform(numbers(False), lambda k: _spots(F.col("found"), k, F.col("titled"))))
    rows = rows.where(F.forall("spots", lambda x: F.size(x) > 0))
    rows = rows.where(F.forall(whole, lambda k: F.size(_spots(F.col("found"), k, F.col("titled"))) == 0))
    scored = rows.select("query_id", "paper_id", _cover_density(F.flatten("spots"), F.col("wanted"), F.col("length")).alias("part"))
    return scored.groupBy("query_id", "paper_id").agg(F.round(F.sum("part"), 6).alias("rank"))


def search_queries(queries: DataFrame, postings: DataFrame, papers: DataFrame, limit: int = CANDIDATES, lexer: str = ENGLISH) -> DataFrame:
    """(query_id, paper_id, rank, krank): each query's best `limit` matches among papers, newest first on ties."""
    found = match_queries(queries, postings, lexer).join(papers.select("paper_id", "published_at"), "paper_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.desc("published_at"), "paper_id")
    return found.withColumn("krank", F.row_number().over(order)).where(F.col("krank") <= limit).select("query_id", "paper_id", "rank", "krank")


def web_search(query: str, postings: DataFrame | None, papers: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(paper_id, rank, krank) of one query: search_queries of a set of one, or without stored postings one reading of the papers."""
    one = papers.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    if postings is None:
        from quillon.operators import scan

        return scan.search(one, papers, limit).drop("query_id")
    return search_queries(one, postings, papers, limit).drop("query_id")
