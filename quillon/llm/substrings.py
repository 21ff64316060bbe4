"""Substring dedup: Rabin-Karp hashes of every 50-word window, counted over the corpus; repeated windows are cut out.

The operator removes each word that lies in a window whose word sequence also starts in a document with a smaller id.
Overlapping windows of one document merge into maximal removal intervals. Windows are compared by 64-bit hashes of
hashed words (n windows meet by chance n**2 / 2**65 times: 0.0002 on 120 million windows).

Defined cases: a null or blank text has no words; texts under 50 words lose nothing; rows that share an id count as one
document and never cut each other; a row without an id keeps all its words and cuts no other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import blocks as B
from quillon.llm.words import Words, runs, windows

WIDTH = 50
SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string"


class _Windows:
    """A block's windows in the order of their hashes; `sent`: of the least document for each hash in the block."""

    def __init__(self, block: pa.Table, width: int):
        ids = block.column("doc_id")
        valid = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.words = Words(block.column("text"))
        at, h = windows(self.words, self.words.hashes(), width)
        text = np.searchsorted(self.words.before, at, "right") - 1
        own = valid[text]
        at, h, text = at[own], h[own], text[own]
        order = np.argsort(h, kind="stable")
        self.at, self.h, doc = at[order], h[order], self.ids[text[order]]
        first = runs(self.h)
        self.later = np.zeros(len(doc), bool)
        if len(doc):
            least = np.minimum.reduceat(doc, first)
            self.later = doc > np.repeat(least, np.diff(np.append(first, len(doc))))
        self.sent = np.flatnonzero(~self.later)
        self.doc = doc[self.sent]


def _make(width: int, buckets: int):
    def make(payload: bytes) -> list[tuple[int, bytes]]:
        w = _Windows(B.open_table(payload), width)
        h = w.h[w.sent]
        bounds, out = B.bucket_bounds(h, buckets), []
        for b in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[b], bounds[b + 1])
            names, index = np.unique(w.doc[part], return_inverse=True)
            index = index.astype(np.uint16 if len(names) < 1 << 16 else np.uint32)
            out.append((int(b), B.join_parts([B.pack_sorted(h[part]), np.diff(names, prepend=0).tobytes(), index.tobytes()])))
        return out

    return make


def _reduce(bucket: int, payloads: list[bytes]) -> tuple[list[bytes], dict]:
    hashes, docs = [], []
    for payload in payloads:
        h, names, index = B.split_parts(payload)
        names = np.cumsum(np.frombuffer(names, np.int64))
        hashes.append(B.unpack_sorted(h))
        docs.append(names[np.frombuffer(index, np.uint16 if len(names) < 1 << 16 else np.uint32)])
    sizes = [len(x) for x in hashes]
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    del hashes, docs
    order = np.argsort(h, kind="stable")
    first = runs(h[order])
    doc_sorted = doc[order]
    least = np.minimum.reduceat(doc_sorted, first)
    later = np.zeros(len(h), bool)
    later[order] = doc_sorted > np.repeat(least, np.diff(np.append(first, len(h))))
    return [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])], {}


def _finish(width: int, buckets: int):
    def finish(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        block = B.open_table(payload)
        w = _Windows(block, width)
        bounds = B.bucket_bounds(w.h[w.sent], buckets)
        for b in np.flatnonzero(np.diff(bounds)):
            n = int(bounds[b + 1] - bounds[b])
            bits = np.unpackbits(np.frombuffer(B.reply(replies, int(b)), np.uint8), count=n).astype(bool)
            w.later[w.sent[bounds[b] : bounds[b + 1]]] = bits
        cut = np.zeros(len(w.words.start) + 1, np.int32)
        at = w.at[w.later]
        np.add.at(cut, at, 1)
        np.add.at(cut, at + width, -1)
        gone = np.cumsum(cut[:-1]) > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.words.before])
        texts, spans = [], []
        for i, text in enumerate(block.column("text").to_pylist()):
            words = (text or "").encode().split()
            own = []
            if n_removed[i]:
                mask = gone[w.words.before[i] : w.words.before[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                own = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]
                words = [x for x, k in zip(words, mask.tolist()) if not k]
            spans.append(own)
            texts.append(b" ".join(words).decode())
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(w.words.count.astype(np.int64)),
                "n_removed": pa.array(n_removed.astype(np.int64)),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept_text": pa.array(texts, pa.string()),
            }
        )

    return finish


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int | None = None) -> DataFrame:
    """Per row: n_words, n_removed, the removed word intervals (end exclusive), and the kept words joined by one space."""
    docs = docs.select("doc_id", "text")
    sizes = B.plan(docs, block_bytes)
    blocks = B.cut_once(docs, sizes)
    return B.meet(blocks, B.answer(B.send(blocks, _make(width, sizes.buckets)), _reduce), _finish(width, sizes.buckets), SCHEMA)
