"""Keyword search of query sets against a plain reading of its rules, and the stemmer against published pairs."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.stem import STOP_WORDS, stem
from quillon.operators import keyword as K

T0 = datetime(2026, 9, 1)
#: Fixed: words and stems of the published algorithm's sample vocabulary.
STEMS = """consign consign consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci constable constabl
constancy constanc knackeries knackeri knavish knavish kneaded knead kneeling kneel knees knee knives knive knocker knocker knitting knit knights knight generously generous communication communic skies sky dying die news news flies fli
ties tie gas gas this this bias bias exceed exceed relational relat conditional condit digitizer digit radically radic goodness good hopeful hope electrical electr formative format adoption adopt controlling control roll roll
rate rate boyish boyish youth youth agreed agre feed feed hopping hop hoping hope happy happi says say""".split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2])))
def test_published_stems(word, want):
    assert stem(word) == want


@given(st.text("abcdefghilmnorstuvyz", min_size=1, max_size=14))
def test_stems_are_no_longer_than_a_letter_more(word):
    assert 0 < len(stem(word)) <= len(word) + 1


def tokens(text, lexer):
    if lexer == K.SIMPLE:
        return [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
    return [None if w in STOP_WORDS else stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]


def plainly(query, title, abstract, lexer):
    """The rank of a paper, or None where it does not match."""
    own = tokens(title, lexer)
    titled, words = len(own), own + tokens(abstract, lexer)

    def spots(phrase):
        ends = [p for p in range(len(words)) if all(p + d < len(words) and words[p + d] == t for t, d in phrase)]
        return [(p, p + phrase[-1][1], sum(1.0 if p + d < titled else 0.4 for _, d in phrase) / len(phrase)) for p in ends]

    total, matched = 0.0, False
    for group in K.parse(query, lexer):
        wanted = [p for minus, p in group if not minus]
        if not wanted or not all(bool(spots(p)) != minus for minus, p in group):
            continue
        matched, begun, latest = True, -1, {}
        for a, b, k, w in sorted((a, b, k, w) for k, p in enumerate(wanted) for a, b, w in spots(p)):
            latest[k] = (a, b, w)
            if len(latest) == len(wanted):
                first, last = min(x[0] for x in latest.values()), max(x[1] for x in latest.values())
                if first > begun:
                    spare = last - first - (len(wanted) - 1) if last - first >= len(wanted) else 0
                    total += sum(x[2] for x in latest.values()) / len(wanted) / (1 + spare)
                    begun = first
    return total / (1 + math.log(max(len(words), 1))) if matched else None


@pytest.fixture(scope="module")
def papers():
    r = random.Random(2)
    vocabulary = ["running", "dogs", "the", "of", "cats", "a_b", "x1", "Zebra", "ZEBRAS", "nation", "national", "über", "or", "not"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", ".", "-"]) for _ in range(n))
    out = [(k, text(r.randrange(5)), text(r.randrange(40)), T0 + timedelta(hours=k % 5)) for k in range(80)]
    return out + [(100, None, None, T0), (101, "", "dogs " * 3000, T0), (102, "dogs cats", None, T0), (103, None, "dogs cats", None)]


@pytest.fixture(scope="module")
def asked():
    r = random.Random(3)
    pieces = ["dogs", "running", '"running dogs"', '"dogs of the cats"', "-zebra", '-"cats dogs"', "or", "OR", "nation", "über", '"the of"', "a_b", '"x1 dogs cats"', "-", '"', '"dogs dogs"', '"or"']
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(60)]
    return list(enumerate([*texts, None, "", "-dogs", "the of", "or or", "zebra zebra", "dogs or dogs", '"dogs cats" cats -"the zebra"']))


@pytest.mark.parametrize("lexer", [K.ENGLISH, K.SIMPLE])
@pytest.mark.parametrize("small", [True, False])
def test_query_sets(spark, papers, asked, lexer, small, monkeypatch):
    if not small:
        monkeypatch.setattr(K, "BROADCAST_TERMS", 3)
    rows = spark.createDataFrame([(*p, 1, "x") for p in papers], "paper_id long, title string, abstract string, published_at timestamp, term int, positions string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string").repartition(2)
    got = {(r.query_id, r.paper_id): r["rank"] for r in K.match_queries(queries, K.position_postings(rows, lexer), lexer).collect()}
    want = {(q, p): rank for q, text in asked for p, title, abstract, _ in papers if (rank := plainly(text or "", title, abstract, lexer)) is not None}
    assert len(want) > 300 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_best_of_each_query(spark, papers, asked):
    rows = spark.createDataFrame(papers, "paper_id long, title string, abstract string, published_at timestamp")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    post = K.position_postings(rows)
    every, best = K.match_queries(queries, post).collect(), K.search_queries(queries, post, rows, 4).collect()
    when = {p[0]: p[3] for p in papers}
    for q in {r.query_id for r in every}:
        order = sorted((r for r in every if r.query_id == q), key=lambda r: (-r["rank"], -(when[r.paper_id] or datetime(1970, 1, 1)).timestamp(), r.paper_id))
        assert [(r.paper_id, r.krank) for r in sorted((b for b in best if b.query_id == q), key=lambda b: b.krank)] == [(r.paper_id, k + 1) for k, r in enumerate(order[:4])]


def test_empty(spark, papers, asked):
    rows = spark.createDataFrame(papers, "paper_id long, title string, abstract string, published_at timestamp")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    assert K.search_queries(queries.limit(0), K.position_postings(rows), rows).count() == 0
    assert K.search_queries(queries, K.position_postings(rows.limit(0)), rows.limit(0)).count() == 0


def test_parsing_and_phrases_stay_in_the_plan(spark, papers, asked):
    """The only Python is the parser of queries and the stemmer of texts; positions and rank are expressions."""
    rows = spark.createDataFrame(papers, "paper_id long, title string, abstract string, published_at timestamp")
    plan = K.match_queries(spark.createDataFrame(asked, "query_id long, text string"), K.position_postings(rows, K.SIMPLE), K.SIMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and F is not None
