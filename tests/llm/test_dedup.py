"""Deduplication operators against plain brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import graph, lines, neardup, substrings
from quillon.llm.words import Words, rolling, windows


def words(t):
    return (t or "").encode().split()


def by_row(df, *columns):
    return Counter((r.doc_id, *(r[c] for c in columns)) for r in df.collect())


def brute_substrings(rows, width=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1) if d is not None else ():
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, d), d)
    out = Counter()
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_substrings(docs, rows, block_bytes):
    got = substrings.dedup_substrings(docs, block_bytes=block_bytes)
    assert by_row(got, "n_words", "n_removed", "kept_text") == brute_substrings(rows)
    for r in got.collect():
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed


def test_substrings_of_another_width(docs, rows):
    assert by_row(substrings.dedup_substrings(docs, width=7), "n_words", "n_removed", "kept_text") == brute_substrings(rows, 7)


def test_rolling_hashes_name_windows():
    texts = ["a b c a b c a b c", "b c a", "", None, "a b"]
    w = Words(pa.array(texts))
    at, h = windows(w, w.hashes(), 3)
    grams = [tuple(x) for t in texts for x in zip(*[words(t)[k:] for k in range(3)])]
    assert len(h) == len(grams)
    assert len(set(h.tolist())) == len(set(grams))
    assert all((a == b) == (x == y) for a, x in zip(h, grams) for b, y in zip(h, grams))
    assert len(rolling(np.zeros(2, np.uint64), 3)) == 0


def brute_lines(rows, least=8):
    last = 1 << 70
    place = lambda d: last if d is None else d
    docs_ = []
    for d, t in rows:
        raw = (t or "").split("\n")
        filled = [k for k, x in enumerate(raw) if words(x)]
        docs_.append((d, raw, filled, [raw[k].encode().strip(b" \t\n\r\x0b\x0c") for k in filled], [len(words(raw[k])) for k in filled]))
    first = {}
    for d, _, _, ids, _ in docs_:
        for i in range(len(ids)):
            for n in range(1, min(least, len(ids) - i) + 1):
                g = tuple(ids[i : i + n])
                first[g] = min(first.get(g, (place(d), i)), (place(d), i))
    out = Counter()
    for d, raw, filled, ids, size in docs_:
        gone = set()
        for i in range(len(ids)):
            for n in range(1, min(least, len(ids) - i) + 1):
                if sum(size[i : i + n]) >= least and first[tuple(ids[i : i + n])] < (place(d), i):
                    gone.update(range(i, i + n))
        out[d, len(ids), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in {filled[j] for j in gone})] += 1
    return out


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_lines(docs, rows, block_bytes):
    assert by_row(lines.dedup_lines(docs, block_bytes=block_bytes), "n_lines", "n_removed", "kept_text") == brute_lines(rows)


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_runs_are_copies_of_their_sources(docs, rows, block_bytes):
    lines_of = {}
    for d, t in rows:
        lines_of.setdefault(d, []).append([x.encode().strip(b" \t\n\r\x0b\x0c") for x in (t or "").split("\n") if words(x)])
    n_runs = 0
    for r in lines.dedup_lines(docs, block_bytes=block_bytes).collect():
        covered = set()
        for x in r.runs:
            n_runs += 1
            size = x.stop - x.start
            copies = [own[x.start : x.stop] for own in lines_of[r.doc_id] if len(own) == r.n_lines]
            assert any(a == own[x.source_start : x.source_start + size] for a in copies for own in lines_of[x.source_id])
            assert r.doc_id is None or (x.source_id, x.source_start) < (r.doc_id, x.start)
            covered.update(range(x.start, x.stop))
        assert len(covered) == r.n_removed
    assert n_runs > 5


def test_long_runs_are_found_whole(spark):
    body = [f"line number {k} of the text {k * k}" for k in range(77)]
    texts = {1: body, 2: ["own first line here", *body[:50], "own last line here"], 3: ["x y z", *body[13:], "a b c d"], 4: body[60:] + body[:5]}
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in lines.dedup_lines(docs, block_bytes=1000).collect()}
    assert got == {1: [], 2: [(1, 51, 1, 0)], 3: [(1, 65, 1, 13)], 4: [(0, 17, 1, 60), (17, 22, 1, 0)]}


def test_lines_of_other_lengths(docs, rows):
    for least in (1, 2, 5):
        assert by_row(lines.dedup_lines(docs, min_words=least), "n_lines", "n_removed", "kept_text") == brute_lines(rows, least)


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_ranks_are_a_suffix_array(docs, block_bytes):
    """Order and equality of ranks are those of the sequences of line ids, at every depth."""
    from quillon.llm import blocks

    own = docs.select("doc_id", "text")
    ranked = {1: [], 2: [], 4: [], 8: []}
    sizes = blocks.plan(own, block_bytes)
    for r in lines.suffix_ranks(blocks.cut_once(own, sizes), sizes).collect():
        state = __import__("pickle").loads(blocks.unsqueeze(r.payload))
        for depth, out in ranked.items():
            for i, rank in enumerate(state.get(f"rank{depth}", np.zeros(0)).tolist()):  # a block may be done before
                if rank:
                    assert (np.diff(state["number"][i : i + depth]) == 1).all() and len(set(state["text"][i : i + depth].tolist())) == 1
                    out.append((rank, tuple(state["hash"][i : i + depth].tolist())))
    assert len(ranked[1]) > 20 and len(ranked[4]) > 5
    for out in ranked.values():
        out.sort()
        for (a, x), (b, y) in zip(out, out[1:]):
            assert (a == b) == (x == y) and x <= y


def test_lines_apply_keeps_rows_and_columns(docs, rows):
    got = lines.apply(docs)
    assert got.columns == docs.columns
    want = Counter({(d, t): n for (d, n_lines, gone, t), n in brute_lines(rows).items() if not gone or len(words(t)) >= lines.LEAST_LEFT})
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        component = min(ids) if ids and ids[0] is not None else None
        out[d, len(sets[i]), component, d is not None and d == component] += 1
    return out


def test_near_duplicates(docs, rows):
    assert by_row(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute_classes(rows)


def test_near_duplicates_around_one_original(spark):
    """Copies that are linked with the original but not with each other are one class; none of them needs to be its seed."""
    import random

    r = random.Random(1)
    base = [f"v{r.randrange(10**6)}" for _ in range(400)]
    rows = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for i in r.sample(range(0, 400, 10), 6):
            w[i] = f"n{k}x{i}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute_classes(rows)


def test_large_groups_are_dealt(docs, rows, monkeypatch, spark):
    """Blocks of large groups give the same classes, whatever the limits are."""
    import random

    monkeypatch.setattr(neardup, "MOST_IN_BUCKET", 4)
    monkeypatch.setattr(neardup, "MOST_IN_CLASS", 6)
    assert by_row(neardup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute_classes(rows)
    r = random.Random(2)
    base = [f"v{r.randrange(10**6)}" for _ in range(300)]
    many = [(77, " ".join(base))]
    for k in range(40):
        w = list(base)
        for i in r.sample(range(0, 300, 10), 4):
            w[i] = f"n{k}x{i}"
        many.append((100 + k, " ".join(w)))
    table = spark.createDataFrame(many, "doc_id long, text string")
    assert by_row(neardup.near_duplicates(table), "n_shingles", "component_id", "kept") == brute_classes(many)


def test_near_dup_apply_keeps_one_of_a_group(docs, rows):
    got = neardup.apply(docs)
    assert got.columns == docs.columns
    components = {}
    for (d, n, c, k), _ in brute_classes(rows).items():
        if n and c is not None:
            components.setdefault(c, set()).add(d)
    blank = Counter(d for d, t in rows if not words(t))
    want = Counter(dict.fromkeys(components, 1)) + blank
    assert Counter(r.doc_id for r in got.collect()) == want


def test_near_dup_apply_keeps_one_of_equal_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    data = [(7, text, "b"), (7, text, "a"), (7, text, "a"), (9, text, "a"), (None, text, "a"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (None, None, "x"), (5, "other words of some text here", "x")]
    got = neardup.apply(spark.createDataFrame(data, "doc_id long, text string, near_row string").repartition(3))
    left = Counter((r.doc_id, r.text, r.near_row) for r in got.collect())
    assert sum(n for (d, t, _), n in left.items() if t == text) == 1 and {d for d, t, _ in left if t == text} == {7}
    assert left[3, None, "x"] == 2 and left[4, "", "x"] == left[None, None, "x"] == left[5, "other words of some text here", "x"] == 1


def test_estimate_follows_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n, shared in ((500, 480), (500, 300), (50, 45)):
        a, b = pool[:n], pool[n - shared : 2 * n - shared]
        sketch = neardup.registers(np.concatenate([a, b]), np.array([0, n]))
        got = neardup.estimate(sketch[0], n, sketch[1:], np.array([n]))[0]
        assert abs(got - shared / (2 * n - shared)) < 0.12


@pytest.mark.parametrize("ratio", [1.0, 0.93, 0.86])
def test_joint_loss_of_bands_and_estimate(ratio):
    """A pair at the limit is lost where it shares no band or its estimate is too low: summed over all counts of greater and less registers."""
    n, size, similar = neardup.REGISTERS, 1000.0, neardup.LINK / 100
    u = 1 / (1 + ratio)
    step = lambda x: -math.log1p(-x * (neardup.BASE - 1) / neardup.BASE) / math.log(neardup.BASE)
    up, down = step(u - (1 - u) * similar), step((1 - u) - u * similar)
    loss = (1 - (1 - up - down) ** (n // neardup.BANDS)) ** neardup.BANDS
    for greater in range(n + 1):
        less = np.arange(n - greater + 1)
        others = np.ones((len(less), n), np.uint8)
        others[:, :greater] = 0
        for k in less:
            others[k, greater : greater + k] = 2
        lost = less[~neardup._near(np.ones(n, np.uint8), size, others, np.full(len(less), size * ratio))]
        ways = lambda k, m: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        loss += sum(math.exp(ways(greater, n) + ways(int(k), n - greater) + greater * math.log(up) + int(k) * math.log(down) + (n - greater - int(k)) * math.log(1 - up - down)) for k in lost)
    assert loss < 2e-7


def test_sketches_merge():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 63, (2, 300)).astype(np.uint64)
    both = np.unique(np.concatenate([a, b]))
    x = neardup.registers(np.concatenate([a, b, both]), np.array([0, 300, 600]))
    assert (np.maximum(x[0], x[1]) == x[2]).all()


def test_linked_is_exact():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = [base] + [np.unique(np.concatenate([np.delete(base, r.choice(len(base), k, replace=False)), r.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (5, 10, 14, 40, 60)]
    got = neardup.linked(sets)
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    near = [link(base, s) for s in sets]
    assert [g == got[0] for g in got] == near


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 9), (3, 3)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6)}


def test_empty_tables(empty):
    assert substrings.dedup_substrings(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert lines.apply(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.apply(empty).count() == 0


def test_query_digest(spark, tmp_path, docs, rows):
    from quillon.llm.queries import op5_substring_dedup

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter({(d, n, gone, hashlib.sha256(t.encode()).hexdigest()): c for (d, n, gone, t), c in brute_substrings(rows).items()})
    assert by_row(op5_substring_dedup(spark, str(tmp_path)), "n_words", "n_removed", "kept_sha256") == want


def test_pairs_behind_a_frequent_line_are_dealt_to_all_buckets():
    """One header line before many different repeated lines: no bucket gets over twice its share of the round after it."""
    from quillon.llm import lines as L

    docs = [[0, 1 + k % 4000] for k in range(8000)]
    text = np.repeat(np.arange(len(docs)), 2)
    rank = np.array([x for d in docs for x in d], np.uint64) + np.uint64(1)
    state = {"rank1": rank, "hash": rank, "text": text, "number": np.tile([0, 1], len(docs)), "doc": np.arange(len(docs))}
    buckets = 8
    edges = L._edges([L._sampled(state, 1, (2,), 1024)], buckets)
    [(at, first, second)] = L._pairs(state, 1, (2,))
    order = np.lexsort((second, first))
    pairs = np.unique(np.stack([first, second])[:, order], axis=1)
    sizes = np.diff(L._bounds(pairs[0], pairs[1], 1, edges))
    assert sizes.sum() == 4000 and len(sizes) == buckets and sizes.max() <= 2 * 4000 / buckets


def test_edges_keep_the_order_of_pairs():
    from quillon.llm import lines as L

    r = np.random.default_rng(2)
    pairs = r.integers(0, 6, (2, 500)).astype(np.uint64)
    edges = L._edges([pairs.tobytes(), b""], 7)
    own = np.unique(pairs, axis=1)
    bounds = L._bounds(own[0], own[1], 1, edges)
    assert (np.diff(bounds) >= 0).all() and bounds[0] == 0 and bounds[-1] == own.shape[1]
    for (f, s), b in zip(zip(*edges), bounds[1:-1]):
        assert all((a, c) < (f, s) for a, c in own[:, :b].T) and all((a, c) >= (f, s) for a, c in own[:, b:].T)
    assert len(L._bounds(own[0], own[1], 1, L._edges([], 7))) == 2
