"""Language model, toxicity, quality ledger and mixing."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lm, mixing, quality, toxicity


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def held(d):
    import zlib

    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_lm_against_the_automaton(docs, rows, block_bytes):
    model = lm.BackoffAutomaton([t for d, t in rows if not held(d)])
    got = Counter()
    for r in lm.score_texts(docs, ~held_out(), block_bytes).withColumn("base", lm.base_score()).collect():
        got[r.doc_id, not r.train, r.n_tokens, r.n_known, r.n_train, round(r.base, 6), round(r.score, 6)] += 1
    want = Counter()
    for d, t in rows:
        own = model.tokens(t)
        base = sum(math.log10(model.probability((), w)) for w in own)
        want[d, held(d), len(own), sum(w in model.arcs[()] for w in own), model.n, round(base, 6), round(model.score(t), 6)] += 1
    assert got == want


def test_automaton_is_normalised_and_walks_its_arcs():
    model = lm.BackoffAutomaton(["a b a c", "a b", None, "c c c"])
    assert {len(s) for s in model.arcs} == {0, 1, 2}
    for state in model.arcs:
        known = sum(model.probability(state, w) for w in model.arcs[()])
        assert math.isclose(known + model.probability(state, b"never"), 1.0, rel_tol=1e-12)
        for w in [*model.arcs[()], b"never"]:
            weight, after = model.step(state, w)
            assert math.isclose(10**weight, model.probability(state, w), rel_tol=1e-12)
            assert after in model.arcs and (*state, w)[len((*state, w)) - len(after) :] == after


def test_blocks_do_not_depend_on_how_the_input_is_split(spark, rows, tmp_path):
    """Between any two actions the number of cores, and with it the splits of the files, may change."""
    from quillon.llm import lines, substrings

    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    key = "spark.sql.files.minPartitionNum"
    out = {}
    try:
        for name, run in {
            "lm": lambda: lm.score_texts(docs, ~held_out(), 3000),
            "lines": lambda: lines.dedup_lines(docs, block_bytes=3000),
            "substrings": lambda: substrings.dedup_substrings(docs, block_bytes=3000),
        }.items():
            spark.conf.set(key, 8)
            out[name, 0] = Counter(map(repr, run().collect()))
            later = run()
            spark.conf.set(key, 1)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
            out[name, 1] = Counter(map(repr, later.collect()))
            assert sum(out[name, 0].values()) == len(rows)
            if name == "lm":  # sums of other blocks differ behind the ninth digit
                assert {x.split("score")[0] for x in out[name, 0]} == {x.split("score")[0] for x in out[name, 1]}
            else:
                assert out[name, 0] == out[name, 1]
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lm_without_training_rows(docs, empty):
    got = lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.score == 0.0 and r.n_train == 0 for r in got)
    assert lm.score_texts(empty, F.lit(True)).count() == 0


def brute_quality(t):
    import re

    t = t or ""
    w = t.encode().split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(five)
    cover = {j for i, g in enumerate(five) if n[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(cover)


def test_quality_measurements(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(docs).collect())
    assert got == Counter((d, *brute_quality(t)) for d, t in rows)


def test_quality_policies_and_ablation(spark):
    ok = " ".join(f"word{k}" for k in range(40))
    texts = [ok, "too short", "ha " * 50, " ".join(f"w{k}$$$" for k in range(30)), "\n".join(["the same line here now"] * 8 + [ok]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = quality.ledger(docs).cache()
    kept = lambda p: {r.doc_id for r in quality.judge(entries, p).where("kept").collect()}
    assert kept("v1") == {0}
    assert kept("v0") == {0, 3}
    table = {r.rule: (r.n_failed, r.n_only) for r in quality.ablate(entries).collect()}
    assert table["symbols"] == (1, 1)
    assert table["too_few_words"] == (2, 2)
    assert table["repeated_windows"][0] == 2
    assert {r.doc_id for r in quality.apply(docs).collect()} == {0}


def test_quality_apply(docs, empty, rows):
    got = quality.apply(docs)
    assert got.columns == docs.columns
    keep = {(r.doc_id, r.n_words) for r in quality.judge(quality.ledger(docs)).where("kept").collect()}
    assert {(r.doc_id, len((r.text or "").split())) for r in got.collect()} == keep
    assert quality.apply(empty).count() == quality.ledger(empty).count() == 0


def texts_with_labels(n, seed):
    r = np.random.default_rng(seed)
    plain = [f"p{k}" for k in range(300)]
    bad = ["vile", "rotten", "filthy", "nasty"]
    texts, labels = [], []
    for k in range(n):
        w = list(r.choice(plain, int(r.integers(20, 200))))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(int(r.integers(len(w))), str(r.choice(bad)))
        texts.append(" ".join(w))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_toxicity_learns_and_scores_held_out(spark):
    texts, labels = texts_with_labels(500, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)], "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, marks, learn).collect()}
    out = {r.doc_id for r in docs.where(~learn).collect()}
    right = [(got[k] >= 0.3) == (labels[k] > 0) for k in out]
    assert len(out) > 80 and np.mean(right) > 0.95


def test_toxicity_reads_to_the_end(spark):
    texts, labels = texts_with_labels(400, 4)
    net = toxicity.train(texts, labels)
    import pyarrow as pa

    plain = " ".join(["p1 p2 p3 p4 p5"] * 3000)
    logit, text = net.windows(toxicity.Reader(pa.array([plain, plain + " vile nasty filthy rotten"])))
    best = toxicity._highest(logit, text, 2)
    assert best[1] > best[0] + 1


def test_windows_cover_and_overlap():
    import pyarrow as pa

    reader = toxicity.Reader(pa.array(["a " * 100, "", None, "b", "c " * 33]))
    first, text = reader.windows()
    for k, n in enumerate([100, 0, 0, 1, 33]):
        starts = (first[text == k] - reader.words.before[k]).tolist()
        assert starts == ([] if not n else list(range(0, max(1, n - toxicity.LENGTH + toxicity.STRIDE), toxicity.STRIDE)))
        assert not n or starts[-1] + toxicity.LENGTH >= n


def naive_scores(net, texts):
    """Every text by plain loops: one window, one word, one unit vector at a time."""
    import re

    import pyarrow as pa

    from quillon.llm.words import NOT_ALNUM, Words

    sig = lambda v: 1 / (1 + np.exp(-v))
    h_size, out = toxicity.HIDDEN, []
    for t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        best = -np.inf
        for start in range(0, max(1, len(words) - toxicity.LENGTH + toxicity.STRIDE), toxicity.STRIDE) if words else ():
            inputs = []
            for w in words[start : start + toxicity.LENGTH]:
                raw = [0, *w.encode(), 0]
                code = [int(toxicity.mix(np.array([raw[i - 1] << 16 | raw[i] << 8 | raw[i + 1]], np.uint64))[0] % np.uint64(toxicity.TRIGRAMS)) for i in range(1, len(raw) - 1)]
                name = Words(pa.array([w]), blank=NOT_ALNUM).hashes()
                inputs.append(np.concatenate([net.w["word"][net.rows(name)[0]], net.w["char"][code].mean(0)]))
            states = np.zeros((len(inputs), 2 * h_size))
            for k, d in enumerate("fb"):
                h = np.zeros(h_size)
                for i in range(len(inputs)) if d == "f" else reversed(range(len(inputs))):
                    g, own = inputs[i] @ net.w[f"x{d}"] + net.w[f"g{d}"], h @ net.w[f"h{d}"]
                    z, r = sig(g[:h_size] + own[:h_size]), sig(g[h_size : 2 * h_size] + own[h_size : 2 * h_size])
                    c = np.tanh(g[2 * h_size :] + r * (own[2 * h_size :] + net.w[f"n{d}"]))
                    h = (1 - z) * c + z * h
                    states[i, k * h_size : (k + 1) * h_size] = h
            energy = states @ net.w["query"]
            share = np.exp(energy - energy.max())
            best = max(best, float(share @ states / share.sum() @ net.w["out"] + net.w["bias"][0]))
        out.append(float(sig(net.slope * best + net.offset)) if words else 0.0)
    return out


def test_toxicity_scores_by_plain_loops(spark):
    """The operator's scores of whole texts are those of every window read on its own."""
    texts, labels = texts_with_labels(120, 6)
    odd = [None, "", "vile", "É vile ünïcödé nasty-words!", " ".join(["p1 p2 filthy"] * 40), "x" * 300]
    docs = spark.createDataFrame(list(enumerate([*texts, *odd])), "doc_id long, text string")
    marked = spark.createDataFrame([(k, int(v)) for k, v in enumerate(labels)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, marked, F.lit(True)).collect()}
    net = next(iter(toxicity._last.values()))
    some = [*range(0, 120, 6), *range(120, 126)]
    want = naive_scores(net, [[*texts, *odd][k] for k in some])
    assert max(abs(got[k] - w) for k, w in zip(some, want)) < 1e-4


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(40)], "doc_id long, text string")
    marked = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, marked, F.lit(True))[0]) == 40
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    texts, labels, share = toxicity.sample(docs, marked, F.lit(True))
    assert len(texts) == 12 and labels.sum() == 6 and share == 0.5


def test_toxicity_gradients():
    texts, labels = texts_with_labels(12, 5)
    import pyarrow as pa

    reader = toxicity.Reader(pa.array(texts))
    net = toxicity.Network(np.sort(reader.names[:50]))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    first, text = reader.windows()
    grid, y = reader.grid(first[:6], text[:6]), labels[text[:6]]
    rows = net.rows(reader.names)
    x = net.inputs(rows, reader.codes, reader.first).astype(np.float64)

    def loss():
        p = toxicity.sigmoid(net.forward(net.gates(x), grid))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, _ = net.backward(x, net.gates(x), grid, y, np.ones(len(y)))
    for name in ("xf", "hb", "nf", "query", "out", "gb"):
        at = tuple(0 for _ in net.w[name].shape)
        keep, e = net.w[name][at], 1e-3
        net.w[name][at] = keep + e
        up = loss()
        net.w[name][at] = keep - e
        down = loss()
        net.w[name][at] = keep
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-4, name


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score == 0.0 for r in toxicity.score_toxicity(docs, none, F.lit(True)).collect())
    odd = spark.createDataFrame([(None, 1), (0, None), (10**9, 1), (0, 0), (0, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, odd, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty, none, F.lit(True)).count() == 0


def test_mix_reaches_the_targets(spark):
    rows = [(k, "w " * (1 + k % 90), "ab"[k % 7 == 0], ["x", "y", "z"][k % 3], "t" if k % 4 else "u") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string")
    cells = mixing.rake(mixing.measured(docs, "kind"), passes=30).collect()
    for d in mixing.DIMENSIONS:
        for name in {r[f"mix_{d}"] for r in cells}:
            own = [r for r in cells if r[f"mix_{d}"] == name]
            assert math.isclose(sum(r.mass for r in own), own[0][f"target_{d}"], rel_tol=1e-6)
    mixed = mixing.mix(docs, "kind", passes=30)
    kept = mixed.where("mix_kept").groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()
    total = sum(r.n for r in kept)
    for r in kept:
        target = next(c.target_source for c in cells if c.mix_source == r.source)
        assert abs(r.n / total - target) < 0.06
    assert mixed.agg(F.max("mix_prob")).first()[0] == 1.0


def test_one_odd_document_does_not_set_the_rate(spark):
    docs = spark.createDataFrame([(k, "w " * 60, "en", f"s{k % 3 % 2}", "k") for k in range(3000)], "doc_id long, text string, lang string, source string, kind string")
    odd = docs.unionByName(spark.createDataFrame([(9000, "w " * 50, "en", None, "k")], docs.schema))
    share = lambda m: m.agg(F.sum(F.col("mix_tokens") * F.col("mix_prob")) / F.sum("mix_tokens")).first()[0]
    assert share(mixing.mix(docs, "kind")) > 0.5 > 0.1 > share(mixing.mix(odd, "kind"))  # the SQL's rule
    for keep in (0.3, 0.9, 1.0):
        assert math.isclose(share(mixing.mix(odd, "kind", keep=keep)), keep, rel_tol=1e-9)
    cells = mixing.calibrated(mixing.rake(mixing.measured(odd, "kind")), 0.3)
    own = {r.category: r for r in mixing.marginals(cells).where("dimension = 'source'").collect()}
    assert own["(none)"].tokens_kept_whole == 50 and own["(none)"].expected < own["(none)"].target
    assert math.isclose(own["s0"].expected / own["s1"].expected, own["s0"].target / own["s1"].target, rel_tol=1e-6)
    with pytest.raises(ValueError):
        mixing.mix(odd, "kind", keep=0.0)


def test_mix_edges(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert {"(none)", "s1"} <= {r.mix_source for r in got} and {r.mix_lang for r in got} == {"(none)", "en"}
    assert not any(r.mix_kept for r in got if not r.mix_tokens and r.mix_weight == 0)
    assert mixing.mix(empty).count() == 0


def test_mix_of_many_cells_joins_without_broadcast(docs, monkeypatch):
    want = sorted((r.doc_id or 0, r.mix_prob) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted((r.doc_id or 0, r.mix_prob) for r in mixing.mix(docs).collect()) == want


def test_mix_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_one_odd_row_does_not_set_the_rate(spark):
    """The registered share holds: one row of a source of its own changes the expected share of the tokens by under a point."""
    from quillon.shared import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = docs.unionByName(spark.createDataFrame([(10**6, "some words of nobody knows what source they come from, and no more than that", None, None, 76)], docs.schema))
    share = lambda m: m.agg(F.sum(F.col("mix_tokens") * F.col("mix_prob")) / F.sum("mix_tokens")).first()[0]
    kept = lambda m: m.agg(F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens"))) / F.sum("mix_tokens")).first()[0]
    plain, other = mixing.mix(docs, keep=mixing.KEEP), mixing.mix(odd, keep=mixing.KEEP)
    assert math.isclose(share(plain), mixing.KEEP, rel_tol=1e-9) and math.isclose(share(other), mixing.KEEP, rel_tol=1e-9)
    assert abs(kept(plain) - kept(other)) < 0.01
