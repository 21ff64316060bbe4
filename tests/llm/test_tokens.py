"""Token-id files: pieces against the library on whole texts, codes against Huffman's, files round."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b ", "\n", " ", "'s", "'", "é", "中", "　", " ", " ", "\u0085", "1", ".", ",", "a,b", "c.\nd", "<|endoftext|>", "\t", "\r", "x y", "Z\nq", "  ", "­", "\x7f", "\x1c", "\U0001d4b3", "\0", "?"]


def whole(texts):
    return [e.ids for e in T.encoder(PATH).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=20)), max_size=12))
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, sizes = T.encoder(PATH).parted(pa.array([*texts, None], pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == whole([*texts, None])


def test_forgetting_pieces(monkeypatch):
    monkeypatch.setattr(T, "KEPT_PIECES", 20)
    r, own = random.Random(1), T.Encoder(PATH)
    for _ in range(20):
        texts = [" ".join(f"w{r.randrange(40)}" for _ in range(10)) for _ in range(3)]
        ids, sizes = own.parted(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == whole(texts)
        assert own.whole(pa.array(texts))[0].tolist() == ids.tolist()


def huffman(counts):
    """Bits of the best code without a limit."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_code_lengths(counts):
    counts = np.array(counts)
    free, tight = T.code_lengths(counts, 60), T.code_lengths(counts, 7)
    assert (free * counts).sum() == huffman(counts.tolist())
    assert tight.max() <= 7 and sum(2.0 ** -tight) <= 1 and (tight * counts).sum() >= (free * counts).sum()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(1, 70))
def test_blocks_decode_apart(ids, block):
    ids = np.array(ids, np.uint32)
    own, counts = np.unique(ids, return_counts=True)
    book = T.Codebook(own, T.code_lengths(counts, 12))
    offsets, bits = book.encode(ids, block)
    assert (book.decode(offsets, bits, len(ids), block) == ids).all()
    last = len(offsets) - 1  # one block alone
    assert (book.decode(offsets[last:], bits, len(ids) - last * block, block) == ids[last * block :]).all()


def key(row):
    return (row[0] is None, row[0] or 0)


@pytest.mark.parametrize("parted", [True, False])
def test_files(spark, docs, rows, tmp_path, parted):
    folder = str(tmp_path / "ids")
    T.write_ids(docs, folder, PATH, parted=parted, segment_ids=500, block_ids=64)
    got = T.texts_of(spark, folder, 64).collect()
    want = [(d, [*ids, 0]) for (d, _), ids in zip(rows, whole([t for _, t in rows]))]
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda d: (d is None, d or 0))
    crc = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in T.digests(spark, folder, 64).collect()}
    assert crc == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_one_id_on_many_rows_is_parted(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(400)] + [(k, "x") for k in range(20)], "doc_id long, text string")
    parts = T.segments(docs, PATH).groupBy("part").agg({"counts": "count"}).count()
    assert parts >= 3


def test_empty(spark, empty, tmp_path):
    T.write_ids(empty, str(tmp_path / "ids"), PATH)
    assert T.texts_of(spark, str(tmp_path / "ids")).count() == 0


def test_query_on_tables(spark):
    """Against the library on every whole text of the smallest tables."""
    from quillon.llm.queries import op12_token_files
    from quillon.shared import table

    data = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, data, "documents").collect())
    at, want = 0, []
    for (doc, _), ids in zip(rows, whole([t for _, t in rows])):
        ids = [*ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op12_token_files(spark, data).collect()) == want
