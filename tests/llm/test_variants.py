"""Spelling variants against deletions of every word, read plainly."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import variants as V

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows, least=V.LEAST_LENGTH, count=V.LEAST_COUNT):
    found = Counter()
    for doc, text in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = x.translate(LOWER)
            h = zlib.crc32(f"{doc}:{x}".encode())
            if doc is not None and h % 31 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            found[x] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def plainly(rows, least=V.LEAST_LENGTH, count=V.LEAST_COUNT):
    words = words_of(rows, least, count)
    near, under = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            under[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in under.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    letters = "abcdeéßÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(7, 15))) for _ in range(30)]

    def changed(w):
        k, how = r.randrange(len(w)), r.randrange(3)
        return w[:k] + ("" if how == 0 else r.choice(letters)) + w[k + (how < 2) :]

    rows = []
    for d in range(60):
        words = [w for w in base for _ in range(r.randrange(6))] + [changed(r.choice(base)) for _ in range(40)] + [changed(changed(base[0])) for _ in range(6)]
        rows.append((d, " ".join(w.upper() if r.random() < 0.2 else w for w in words) + ", I'm a_b9c short."))
    rows += [(100, "aaaaaaa aaaaaaaa aaaaaaaaa " * 50), (101, "aaaaaaa"), (None, "aaaaaaab " * 40), (102, None), (103, ""), (104, "x" * 70_000 + " " + "x" * 70_000), (105, "Ünïcödé ÜNÏCÖDÉ ünïcödé"), (106, "chainword " * 300 + "chainwort " * 20 + "chainwoxt chainwoxt")]
    return rows + [rows[0], rows[0], (-3, rows[1][1])]


def test_equals_deletions(spark, texts):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    want = plainly(texts)
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] not in (None, x[2]) for x in want)
    assert got(V.spelling_variants(docs)) == want


def test_all_operators_rows(spark, docs, rows, empty):
    assert got(V.spelling_variants(docs, 2, 1)) == plainly(rows, 2, 1)
    assert got(V.spelling_variants(empty)) == []
    with pytest.raises(ValueError):
        V.spelling_variants(docs, 1)


def test_shards_over_the_bound(spark, texts):
    """Half of all words share a segment; its shard is dealt to parts and slices."""
    own = [(d, " ".join(["alikealike" + a + b, "alikealike" + a + b])) for d, (a, b) in enumerate((a, b) for a in "abcdefghijkl" for b in "mnopqrstuvwx")]
    own = [(d, t) for d, t in own] + texts[:20]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    assert got(V.spelling_variants(docs, shard_size=40)) == plainly(own)


def test_crc_of_parts():
    for word in ("abcdefg", "x" * 64, "y" * 65, "z" * 5000, "é" * 40):
        raw = word.encode()
        table, c = V._far_shift(len(raw)), zlib.crc32(b"12345:")
        moved = table[0, c & 255] ^ table[1, c >> 8 & 255] ^ table[2, c >> 16 & 255] ^ table[3, c >> 24]
        assert int(moved) ^ zlib.crc32(raw) == zlib.crc32(b"12345:" + raw)
        if len(raw) <= 64:
            assert (V._shifts(64)[len(raw)] == table).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=9), min_size=1, max_size=60, unique=True))
def test_rests_find_all_near(words):
    found = V.Shard((side, half, w, 1) for w in words for side, half in enumerate(V.halves(w)))
    for w in words:
        assert set(found.scan(w)) == {x for x in words if V.near(w, x)}
