"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows scans each text once.

A text is normalised to lower-case words of letters, digits and characters above ASCII; a window is 13 consecutive words
of a benchmark item (a shorter item is one window). Every occurrence of a window marks its words, and marks are mapped back
to offsets of the original text.

An automaton has at most one node (some 40 bytes) for each byte of its windows. The benchmark is read on the driver only if its
windows have at most `max_nodes` bytes, which is checked first. The windows of a larger one are dealt to shards, each of which is
checked against that bound, so a long item is split like any other. Then the texts are still scanned once: a sorted list of
64-bit window hashes (at most `MAX_HASHES` a scan) tells which texts hold a window at all, and the shards' automata read
only those. A hash that two windows share adds a text to read and no hit. Hits are merged per row.

Defined cases: null texts and texts without words have no hits; an item without an id or without words is ignored; items
that repeat an id count once; every row of the input gives one row; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import cut_blocks
from quillon.llm.rows import sealed
from quillon.llm.words import LOWER, NOT_ALNUM, U, Words, rolling
from quillon.llm.words import windows as window_hashes
from quillon.shared import cut

WINDOW, BLOCK = 13, 4 << 20
MAX_NODES, MAX_HASHES = 4 << 20, 4 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SPAN = "array<struct<start:long,stop:long>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, hits {_SPAN}, spans {_SPAN}"
_NORMAL = bytes(0x20 if NOT_ALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(text: str | None, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = normal_words(text)
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def owners_of(items: list[tuple[str, str | None]], width: int = WINDOW) -> dict[bytes, set[str]]:
    """The items of each window of a benchmark."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, width):
            owners.setdefault(b" ".join(window), set()).add(item)
    return owners


class Scanner:
    """The automaton; words are joined by blanks, bytes stand for characters, so matches start and end at words."""

    def __init__(self, owners: dict[bytes, set[str]]):
        self.owners = [sorted(x) for x in owners.values()]
        self.sizes = [x.count(b" ") + 1 for x in owners]
        self.automaton = ahocorasick.Automaton()
        for i, pattern in enumerate(owners):
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", i)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs of words (end exclusive), items that occur."""
        words = normal_words(text)
        if not self.owners or not words:
            return len(words), [], set()
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return len(words), [], set()
        ends = np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, [end for end, _ in found]) + 1
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, last - np.array([self.sizes[i] for _, i in found]), 1)
        np.add.at(cover, last, -1)
        return len(words), _runs(np.cumsum(cover[:-1]) > 0), {x for _, i in found for x in self.owners[i]}


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _original(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in characters of the original text."""
    raw = text.encode()
    where = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
    return [(int(place[where[a][0]]) - 1, int(place[where[b - 1][1] - 1])) for a, b in hits]


_ready: list = []


def _scanner(owners: dict) -> Scanner:
    """One automaton a worker process: of the windows it was last asked for."""
    if not _ready or _ready[0] is not owners:
        _ready[:] = [owners, Scanner(owners)]
    return _ready[1]


def _spans(pairs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in pairs]


def _table(ids, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array([n for n, *_ in rows], pa.int64()),
            pa.array([sum(b - a for a, b in hits) for _, hits, *_ in rows], pa.int64()),
            pa.array([sorted(items) for _, _, items, _ in rows], pa.list_(pa.string())),
            pa.array([_spans(hits) for _, hits, *_ in rows], SPANS),
            pa.array([_spans(_original(text, hits)) if hits else [] for _, hits, _, text in rows], SPANS),
        ],
        ["doc_id", "n_words", "n_hit", "items", "hits", "spans"],
    )


def _scan(docs: DataFrame, owners: dict[bytes, set[str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(owners)

    def task(batches):
        scanner = _scanner(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                yield _table(part.column("doc_id"), [(*scanner.scan(t), t) for t in texts])

    return docs.mapInArrow(task, SCHEMA)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")


def _small(items: DataFrame, width: int, max_nodes: int) -> bool:
    """Whether all windows have at most max_nodes bytes: no word is in more than `width` of them."""
    return (items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) * width <= max_nodes


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(window, n_words, hash, items) of a benchmark, computed once."""

    def task(batches):
        for batch in batches:
            rows = [(item, b" ".join(w), len(w)) for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()) for w in windows_of(text, width)]
            names = pa.array([w for _, w, _ in rows], pa.binary())
            words = Words(pa.array([w.decode("utf-8", "surrogateescape") for _, w, _ in rows], pa.large_string()), blank=NOT_ALNUM)
            codes, n = words.hashes(), np.array([k for *_, k in rows], np.int64)
            hashes = np.array([rolling(codes[a : a + k], int(k))[0] for a, k in zip(words.before, n)], U).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in rows], pa.string()), names, pa.array(n), pa.array(hashes)], ["item", "window", "n_words", "hash"])

    rows = items.mapInArrow(task, "item string, window binary, n_words long, hash long")
    return cut(rows.groupBy("window", "n_words", "hash").agg(F.collect_set("item").alias("items")))


def _holding(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, doc_id, text) of the texts that hold a window, by hash, for each of its numbers of words."""
    scans = max(1, -(-windows.count() // MAX_HASHES))
    out = None
    for k in range(scans):
        own = windows if scans == 1 else windows.where(F.pmod(F.col("hash"), F.lit(scans)) == k)
        by_size: dict[int, list[int]] = {}
        for r in own.select("n_words", "hash").distinct().collect():
            by_size.setdefault(r.n_words, []).append(r.hash)
        shared = docs.sparkSession.sparkContext.broadcast({n: np.sort(np.array(h, np.int64).astype(U)) for n, h in by_size.items()})

        def task(batches, shared=shared):
            for block in cut_blocks(batches, "text", BLOCK):
                words = Words(block.column("text"), lower=True, blank=NOT_ALNUM)
                codes, keep = words.hashes(), np.zeros(block.num_rows, bool)
                for n, known in shared.value.items():
                    at, h = window_hashes(words, codes, n)
                    found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    keep[np.searchsorted(words.before, at[found], "right") - 1] = True
                yield from block.filter(pa.array(keep)).to_batches()

        part = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(task, "key long, doc_id long, text string")
        out = part if out is None else out.unionByName(part)
    return cut(out.dropDuplicates(["key"]))


def _shards(windows: DataFrame, max_nodes: int) -> tuple[DataFrame, int]:
    """windows with a shard, none of over max_nodes bytes of windows (but for a window that has more by itself)."""
    total = windows.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    shards = max(1, -(-2 * total // max_nodes))
    while True:
        dealt = windows.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(shards)))
        if dealt.groupBy("shard").agg(F.sum(F.octet_length("window") + 2).alias("b"), F.count("*").alias("n")).where((F.col("b") > max_nodes) & (F.col("n") > 1)).isEmpty():
            return dealt, shards
        shards *= 2


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_nodes: int = MAX_NODES) -> DataFrame:
    """Per row: n_words, n_hit, the items that occur (sorted strings), hit runs of words, and their spans in the original text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark)
    if _small(items, width, max_nodes):
        return _scan(docs, owners_of([tuple(r) for r in items.collect()], width))
    windows = _windows(items, width)
    holding, (dealt, shards) = _holding(docs, windows), _shards(windows, max_nodes)
    parts = None
    for k in range(shards):
        owners = {bytes(r.window): set(r["items"]) for r in dealt.where(F.col("shard") == k).select("window", "items").collect()}
        part = _scan(holding.select(F.col("key").alias("doc_id"), "text"), owners).where("n_hit > 0")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(F.col("doc_id").alias("key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text")).join(merged, "key", "left")

    def merge(batches):
        for batch in batches:
            rows = []
            for row in batch.select(["text", "items", "hits"]).to_pylist():
                n, hit = len(normal_words(row["text"])), row["hits"] or []
                cover = np.zeros(n + 1, np.int64)
                for x in hit:
                    cover[x["start"]] += 1
                    cover[x["stop"]] -= 1
                rows.append((n, _runs(np.cumsum(cover[:-1]) > 0) if hit else [], row["items"] or [], row["text"]))
            yield _table(batch.column("doc_id"), rows)

    return keyed.select("doc_id", "text", "items", "hits").mapInArrow(merge, SCHEMA)


def apply(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs, all columns whatever their names are, without contaminated rows."""
    items = _items(benchmark)
    docs, names = sealed(docs)
    if not _small(items, width, MAX_NODES):
        keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
        bad = decontaminate(keyed, benchmark, width, MAX_NODES).where(contaminated()).select(F.col("doc_id").alias("key")).distinct()
        return docs.withColumn("key", F.xxhash64("doc_id", "text")).join(bad, "key", "left_anti").select(*docs.columns).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(owners_of([tuple(r) for r in items.collect()], width))

    def task(batches):
        scanner = _scanner(shared.value)
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                n, hits, _ = scanner.scan(text.as_py())
                n_hit = sum(b - a for a, b in hits)
                keep.append(not (n_hit and 20 * n_hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema).toDF(*names)


def contaminated():
    """The contract's rule: at least one hit word, and hits on a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
