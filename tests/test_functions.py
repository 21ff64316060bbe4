"""Pinned values of text functions, extraction, claims and the stemmer."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import claims, extract, register, stem
from quillon.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def s(value):
    return F.lit(value)


@pytest.mark.parametrize(
    "given,want",
    [
        ("2609.01234", "2609.01234"), ("2609.01234v3", "2609.01234"), ("arXiv:2609.01234v2", "2609.01234"), ("https://arxiv.org/abs/2609.01234v1", "2609.01234"), ("http://www.arxiv.org/pdf/2609.01234v1.pdf", "2609.01234"),
        ("https://arxiv.org/html/hep-th/9901001v1", "hep-th/9901001"), ("math.GT/0309136", "math.GT/0309136"), (" 0704.0001 ", "0704.0001"), ("diffusion models", None), ("26090.1234", None), ("see 2609.01234", None),
    ],
)
def test_paper_id(spark, given, want):
    assert one(spark, T.parse_paper_id(s(given))) == want


def test_versions_and_links(spark):
    assert tuple(one(spark, T.split_version(s("2609.01234v2")))) == ("2609.01234", 2)
    assert tuple(one(spark, T.split_version(s("hep-th/9901001v12")))) == ("hep-th/9901001", 12)
    assert tuple(one(spark, T.split_version(s("2609.01234")))) == (None, None)
    assert one(spark, T.versioned_id(s("a"), F.lit(3))) == "av3"
    assert one(spark, T.doi_of(F.lit(None).cast("string"), s("http://dx.doi.org/10.1/x"))) == "10.1/x"
    assert one(spark, T.https(s("http://a/b"))) == "https://a/b"
    assert one(spark, F.date_format(T.parse_time(s("2026-09-01T10:00:00Z")), "yyyyMMddHHmm")) == "202609011000"
    assert one(spark, F.date_format(T.parse_time(s("2026-09-01")), "yyyyMMddHHmm")) == "202609010000"


def test_white_space_and_names(spark):
    assert one(spark, T.normalize_ws(s(" a \n b\t"))) == "a b"
    assert one(spark, T.strip_nul(s("a\x00b"))) == "ab"
    assert one(spark, T.author_norm(s("  José  GARCÍA "))) == "jose garcia"
    assert one(spark, T.norm_title(s("Attention: Is All—You Need!"))) == "attention is all you need"
    assert one(spark, T.display_name(F.lit(None).cast("string"), s("Plato"))) == "Plato"


@pytest.mark.parametrize(
    "title,query,want",
    [("CGS-X: a method of y", None, "CGS-X"), ("A study of one two three four", None, "A study of one two three …"), ("Short title", None, "Short title"), ("T: x", "  my search ", "my search"), ("A: too short a head", None, "A: too short a head"), ("x " * 30, "q" * 60, "q" * 48)],
)
def test_web_name(spark, title, query, want):
    assert one(spark, T.web_name(s(title), F.lit(query).cast("string"))) == want


def test_identifiers_and_scope(spark):
    assert one(spark, T.identifiers(s("how does SAM 2 beat LoRA and pi0.5 in Paris"))) == ["2", "LoRA", "SAM", "pi0.5"]
    key = lambda k, c, q: one(spark, T.scope_key(F.lit(k), F.lit(c).cast("array<string>"), F.lit(None).cast("timestamp"), s(q)))
    assert key(10, ["b", "a"], "plain words") == key(10, ["a", "b"], "other words")
    assert key(10, None, "SAM 2") != key(10, None, "SAM 3") and key(10, None, "x") != key(20, None, "x") and len(key(1, None, "x")) == 16


@pytest.mark.parametrize("sim,want", [(0.85, 1.0), (0.70, 0.5), (0.50, 0.1)])
def test_similar_weight(spark, sim, want):
    assert one(spark, T.similar_weight(F.lit(sim))) == pytest.approx(want)


def test_keys_years_titles(spark):
    null = F.lit(None).cast("string")
    assert one(spark, T.edge_key(s("1"), s("2"), s("t"))) == "arxiv:1"
    assert one(spark, T.edge_key(null, s("2"), s("t"))) == "s2:2"
    assert one(spark, T.edge_key(null, s(""), s("A Title!"))) == "title:a title"
    assert one(spark, T.edge_key(null, null, null)) is None
    assert one(spark, T.last_year(s("in 1999, then 2021 (12345)"))) == 2021 and one(spark, T.last_year(s("none"))) is None
    assert one(spark, T.quoted_title(s("A. B, “Diffusion policy: learning,” in Proc."))) == "Diffusion policy: learning"
    assert one(spark, T.title_name(s("CGS-SLAM: dense"))) == "CGS-SLAM" and one(spark, T.title_name(s("Deep: x"))) is None


def test_passages_and_sentences(spark):
    assert one(spark, T.passage(s("Intro\nbody text"), s("Intro"))) == "body text"
    assert one(spark, T.passage(s("Other\nbody"), s("Intro"))) == "Other\nbody"
    assert one(spark, T.first_sentence(s("Short one. " + "word " * 10 + "end. More here."))) == "Short one. " + "word " * 10 + "end."
    assert one(spark, T.join_hyphens(s("exam-\nple"))) == "example"
    assert one(spark, T.reflow(s("a\nb\n\n \n\nc"))) == "a b\n\nc"
    assert one(spark, T.numbers(s("130 KB, 84,10% and 0.50 of 10–20"))) == ["0.5", "1", "13", "2", "84.1"]
    assert str(one(spark, T.cost(F.lit(1000), F.lit(500), F.lit(4.0), F.lit(20.0)))) == "0.01400"


PAGE = """<html><body><article class="ltx_document"><h1 class="ltx_title ltx_title_document">T</h1><div class="ltx_abstract"><p class="ltx_p">An abstract that is long enough to count.</p></div>
<section class="ltx_section"><h2 class="ltx_title">1 Introduction</h2><div class="ltx_para"><p class="ltx_p">We study <math>x</math> things in   detail, at length here.</p></div>
<section class="ltx_subsection"><h3 class="ltx_title">1.1 Sub</h3><p class="ltx_p">Nested text that stays with the parent section.</p></section></section>
<section class="ltx_section"><h2 class="ltx_title">2 Tiny</h2><p class="ltx_p">too short</p></section>
<section class="ltx_appendix"><h2 class="ltx_title">A Extra</h2><figure class="ltx_figure"><img src="f1.png"/><figure class="ltx_figure"><img src="f1b.png"/></figure><figcaption>Figure 1: Overview of our whole method.</figcaption></figure>
<figure class="ltx_table"><table><tr><td>1</td></tr></table><figcaption>Table 1: numbers that are left out of it</figcaption></figure><figure class="ltx_figure"><img src="f2.png"/><figcaption>Fig. 2. Results</figcaption></figure></section>
<section class="ltx_bibliography"><ul><li class="ltx_bibitem"><span class="ltx_bib_title">Great work.</span> <span class="ltx_bib_year">2020</span> <a href="https://arxiv.org/abs/2001.00001">x</a></li>
<li class="ltx_bibitem">A. B. “Diffusion policy: learning it,” 1999, 2023.</li><li class="ltx_bibitem">nothing usable</li></ul></section></article></body></html>"""


def test_sections():
    got = extract.sections(PAGE)
    assert [t for t, _ in got] == ["1 Introduction", "A Extra"]
    assert got[0][1] == "We study things in detail, at length here.\n\nNested text that stays with the parent section."
    assert extract.sections("<html><body><p>plain page</p></body></html>") == []
    body = extract.sections('<article class="ltx_document"><p class="ltx_p">' + "long text " * 30 + "</p></article>")
    assert body[0][0] == "Body"
    assert extract.sections(None) == []


def test_bibliography_and_figures(spark):
    pages = spark.createDataFrame([(1, PAGE, "https://h.org/p/"), (2, None, None)], "page_id long, html string, url string")
    got = sorted(extract.extract_bibliography(pages).collect())
    assert [tuple(r) for r in got] == [(1, 0, "2001.00001", "Great work", 2020), (1, 1, None, "Diffusion policy: learning it", 2023)]
    figs = extract.extract_figures(pages)
    assert [(r.n, r.images) for r in sorted(figs.collect())] == [(1, ["https://h.org/p/f1.png", "https://h.org/p/f1b.png"]), (2, ["https://h.org/p/f2.png"])]
    pick = lambda n: [r.n for r in extract.overview(figs, "page_id", None if n is None else spark.createDataFrame([(1, n)], "page_id long, chosen int")).collect()]
    assert pick(None) == [1] and pick(2) == [2] and pick(9) == [1]
    plain = spark.createDataFrame([(1, 0, 2, "Our results"), (1, 1, 1, "Setup"), (3, 0, 4, "Results"), (4, 0, 7, "x"), (4, 1, 8, "The Architecture of it")], "k int, place int, n int, caption string")
    assert {(r.k, r.n) for r in extract.overview(plain, "k").collect()} == {(1, 1), (4, 8)}


def test_pdf_text(spark):
    parts = "".join(f"\n\n{k} Heading Number\n\n" + "content words here " * 5 + "\n\nsecond part" for k in (1, 2, 3))
    texts = {
        "cut": "Title\n\nexam-\nple text\n\n" + "filler words " * 40 + "\n\n7. References\n\n[1] a",
        "early": "References\n\n" + "filler words " * 40,
        "heads": parts,
        "front": "front matter " * 20 + parts,
        "short": "short",
        "none": None,
    }
    table = spark.createDataFrame(list(texts.items()), "paper_id string, text string")
    clean = {r.paper_id: r.c for r in extract.clean_pdf_texts(table).select("paper_id", F.col("clean").alias("c")).collect()}
    assert "example text" in clean["cut"] and "[1]" not in clean["cut"] and "References" not in clean["cut"] and clean["early"].startswith("References")
    got = {}
    for r in sorted(extract.extract_pdf_sections(table).collect()):
        got.setdefault(r.paper_id, []).append((r.title, r.text.split()[-1]))
    heads = [("1 Heading Number", "part"), ("2 Heading Number", "part"), ("3 Heading Number", "part")]
    assert got == {"cut": [("Body", "words")], "early": [("Body", "words")], "heads": heads, "front": [("Front matter", "matter"), *heads]}


SOURCE = "We present Visual Geometry Grounded Transformer (VGGT). It streams at 130 KB/s and reaches 84.1% accuracy. The encoder maps images to tokens."
ANSWER = {
    "one_liner": "Describe the paper", "steps": [{"name": "Encode", "does": "maps", "section": "method", "evidence": "The encoder maps images"}, {"name": "Decode", "does": "decodes", "section": "none", "evidence": "never said"}, {"name": " ", "does": "x"}],
    "results": [{"value": "84.1%", "label": "accuracy"}, {"value": "130 MB", "label": "rate"}, {"value": "99", "label": "made up"}, {"value": "fast", "label": "none"}],
    "terms": [{"term": "VGGT", "meaning": "Visual Geometry Grounded Transformer, a model"}, {"term": "VGGT", "meaning": "Very Good Graph Trainer"}, {"term": "GPT", "meaning": "x"}],
}


def checked(spark, answer, source=SOURCE, names=("1 Intro", "2 Method"), fallback="fallback"):
    text = answer if isinstance(answer, str | None) else json.dumps(answer)
    rows = spark.createDataFrame([(1, text, source, list(names), fallback)], "paper_id long, answer string, source string, sections array<string>, fallback string")
    r = claims.check_answers(rows).first()
    return r.design and json.loads(r.design), r.rejected, r.error


def test_claims(spark):
    design, rejected, error = checked(spark, ANSWER)
    assert error is None and design["one_liner"] == "fallback"
    assert [s["section"] for s in design["steps"]] == ["2 Method", ""] and [s["evidence"] for s in design["steps"]] == ["The encoder maps images", ""]
    assert [r["value"] for r in design["results"]] == ["84.1%"] and len(design["terms"]) == 1
    assert [(r["kind"], r["claim"], r["reason"]) for r in rejected] == [
        ("evidence", "never said", "quote not found in the text"), ("result", "130 MB: rate", "number not in the text with this unit"), ("result", "99: made up", "number not in the text"),
        ("result", "fast: none", "number not in the text"), ("term", "VGGT = Very Good Graph Trainer", "acronym expansion not in the text"), ("term", "GPT", "term not in the text"),
        ("one_liner", "Describe the paper", "not a description of the paper"),
    ]


@pytest.mark.parametrize("answer,error", [({"steps": []}, "the model described fewer than two steps"), ("[1]", "answer did not match the schema"), ("{broken", "answer did not match the schema"), (None, "answer did not match the schema"), ({}, "the model described fewer than two steps")])
def test_answers_that_are_none(spark, answer, error):
    assert checked(spark, answer) == (None, [], error)


@pytest.mark.parametrize("term,meaning,words", [
    ("SLAM", "Simultaneous Localization and Mapping", None), ("SLM", "Simultaneous Localization and Mapping", ["simultaneous", "localization", "mapping"]),
    ("GPT", "generative pre-trained transformer", ["generative", "pre-trained", "transformer"]), ("X", "extra words", None), ("AB", "alpha", None), ("ab", "alpha beta", None),
    ("VITS", "Visual Inference of the Total State", ["visual", "inference", "total", "state"]),
])
def test_spelled_out_terms(spark, term, meaning, words):
    assert one(spark, claims.spelled_out(s(term), s(meaning))) == words


@pytest.mark.parametrize("text,stands", [("a visual graph of one total", True), ("visual graph and then one two three total", False), ("graph visual total", False), ("visual-graph total", True)])
def test_words_near_each_other(spark, text, stands):
    assert one(spark, claims.near_each_other(F.array(s("visual"), s("graph"), s("total")), s(text))) is stands


@pytest.mark.parametrize("value,stands", [("130 KB/s", True), ("130 MB", False), ("84.1 %", True), ("84.1", True), ("fast", True), ("1.5 (x)", True)])
def test_units(spark, value, stands):
    assert one(spark, claims.unit_stands(s(value), claims.claim_norm(s(SOURCE)))) is stands


def test_claim_source(spark):
    papers = spark.createDataFrame([(1, "T")], "paper_id long, title string")
    chunks = spark.createDataFrame([(1, 0, "abstract", "T\n\nthe abstract"), (1, 1, "Intro", "Intro\nfirst part"), (1, 2, "Related Work", "Related Work\nskipped"), (1, 3, "Intro", "Intro\nsecond"), (1, 4, "Method", "Method\n" + "x" * 50), (1, 5, "End", "End\ny")], "paper_id long, idx int, section string, text string")
    figs = spark.createDataFrame([(1, 1, "c" * 300)], "paper_id long, n int, caption string")
    got = claims.source_text(papers, chunks, figs, budget=40).first()
    assert got.sections == ["Intro"]
    assert got.text == "Title: T\n\nAbstract:\nthe abstract\n\n\n## Intro\n\nfirst part\n\nsecond\n\n\nFigures:\n\nFigure 1: " + "c" * 240


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("controlling", "control"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("generalizations", "general"), ("probate", "probat"), ("sky", "sky"), ("adjustable", "adjust"), ("effective", "effect")])
def test_stemmer(word, want):
    assert stem.stem(word) == want


def test_lexemes_keep_positions():
    assert stem.lexemes("The running of the dogs") == [("run", 2), ("dog", 5)]


def test_registered_functions(spark):
    names = register.register(spark)
    assert {"norm_title", "extract_sections", "cosine_sim"} <= set(names)
    row = spark.sql("SELECT norm_title('A-B c!') a, parse_paper_id('https://arxiv.org/abs/2609.01234v2') b, similar_weight(0.7D) c, cosine_sim(array(1D, 0D), array(1D, 1D)) d, identifiers('SAM 2 x') e, author_norm('Éva') f, lexemes('running dogs') g").first()
    assert row.a == "a b c" and row.b == "2609.01234" and row.c == pytest.approx(0.5) and row.d == pytest.approx(0.7071068) and row.e == ["2", "SAM"] and row.f == "eva" and row.g == ["run", "dog"]
    words = " ".join(f"w{k}" for k in range(1, 26))
    got = [r.text.split() for r in spark.sql(f"SELECT * FROM chunk_text('{words}', 10, 3)").collect()]
    assert [(w[0], w[-1]) for w in got] == [("w1", "w10"), ("w8", "w17"), ("w15", "w24"), ("w22", "w25")]
    pages = spark.createDataFrame([(PAGE,)], "html string")
    pages.createOrReplaceTempView("p")
    assert spark.sql("SELECT s.title FROM p, LATERAL extract_sections(html) s").count() == 2
    assert spark.sql("SELECT b.year FROM p, LATERAL parse_bibliography(html) b").count() == 2
    assert spark.sql("SELECT f.n FROM p, LATERAL parse_figures(html, 'https://h/') f").count() == 2


def test_sql_names_mean_what_the_columns_mean(spark):
    """Every SQL function of built-in expressions against its Column, on odd input."""
    from quillon.functions import register, text
    from quillon.operators.vectors import cosine

    register.register(spark)
    odd = ["see 2401.00007v2", "foo/2401.00007", " 2401.00007v2 ", "arXiv:2401.00007", "https://arxiv.org/pdf/2401.00007v3.pdf", "http://export.arxiv.org/abs/math.GT/0309136v1/", "hep-th/9901001", "x2401.00007", "2401.00007x", "", None, "A-B c!  É_1", "v2 GPT-4 a.B+c x1"]
    rows = spark.createDataFrame([(s,) for s in odd], "s string")
    for name, column in (("norm_title", text.norm_title), ("parse_paper_id", text.parse_paper_id), ("identifiers", text.identifiers)):
        got = rows.select(F.expr(f"{name}(s)").alias("sql"), column(F.col("s")).alias("own")).collect()
        assert all((sorted(r.sql) if isinstance(r.sql, list) else r.sql) == (sorted(r.own) if isinstance(r.own, list) else r.own) for r in got), name
    sims = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.6, 0.61, 0.7, 0.8, 1.0, None)], "x double")
    assert all(r.a == r.b for r in sims.select(F.expr("similar_weight(x)").alias("a"), text.similar_weight(F.col("x")).alias("b")).collect())
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, -1.0], [0.5, 0.25])], "a array<double>, b array<double>")
    for r in pairs.select(F.expr("cosine_sim(a, b)").alias("a"), cosine(F.col("a"), F.col("b")).alias("b")).collect():
        assert r.a is r.b is None or abs(r.a - r.b) < 1e-12
