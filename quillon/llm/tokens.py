"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Texts are encoded by a tokenizer of the `tokenizers` library, an end id behind each. A pass counts the ids of all texts, the
counts give every id a code length (package-merge, at most `LIMIT` bits), and the lengths alone give the codes: canonical codes are
numbered by length, then id. The ids are then written as segments of whole texts in ascending order. A segment's bits are cut into
blocks of `BLOCK_IDS` ids; the bit offset at which each block begins is stored, so blocks decode apart from each other: a reader looks
the next LIMIT bits up in one table that holds the id and its length, for all blocks of a segment side by side.

Format (a folder): `codebook` is a parquet table of (id, length); `segments` one of (part, segment, start, doc_ids, counts, offsets,
bits), the rows of part p and segment s in file order by (part, segment). start counts the ids of all texts before the segment's,
counts the ids of each of its texts, offsets are little-endian 64-bit bit positions, bits is padded with eight zero bytes. A text lies
in one segment, whole.

The library's encoder is asked once for each distinct piece of a block of texts. Texts fall into pieces before a lone blank and around
a lone line break between printed characters, and between a letter and a stop: byte-level pre-tokenizers part there whatever stands
around, so a text's ids are its pieces' ids one after the other (`parted=False` for tokenizers of another kind; tests hold both
against the library on whole texts).

Scale: texts are dealt by ranges of (doc_id, a hash of the text), so one id on a third of all rows is parted too; a part is cut
into segments of about `SEGMENT_IDS` ids, which stand in the shared checkpoint folder between counting and coding. The driver gets the
number of ids of each part, and counts of at most as many ids as the vocabulary has.

Defined cases: a null or empty text is its end id alone; rows without an id come last; rows of one id go by a hash of their texts and
repeated rows are written each; an empty table gives an empty codebook; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.blocks import cut_blocks, release, squeeze, unsqueeze
from quillon.llm.words import U, text_bytes
from quillon.shared import cut

END_ID, LIMIT = 0, 18
#: Ids of a block (decoded side by side) and of a segment.
BLOCK_IDS, SEGMENT_IDS = 256, 1 << 20
BLOCK, PART_BYTES = 8 << 20, 64 << 20
#: Ids up to which a table by id is kept.
DENSE = 1 << 22
SEGMENT = "part int, segment int, doc_ids array<long>, counts array<long>, ids binary"
CODED = "part int, segment int, start long, doc_ids array<long>, counts array<long>, offsets binary, bits binary"


# -- encoding texts --------------------------------------------------------------------------------

#: Lead bytes of the characters among which there are blanks above ASCII.
_ODD_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[list(b".,;:!?")] = True
_ODD = np.isin(np.arange(256), _ODD_LEADS)
#: Pieces whose ids a worker keeps (some 150 bytes each); all are dropped when there are more.
KEPT_PIECES = 5 << 18


def pieces(column) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each piece's distinct piece, the distinct pieces, pieces before each text) of the texts of a column. Texts are cut
    where a byte-level pre-tokenizer always parts: before a lone blank and around a lone line break that stand between printed
    characters, and between an ASCII letter and a stop."""
    data, offsets = text_bytes(column)
    total = len(data) - 8
    raw = data[:total]
    edges = offsets[:-1][np.diff(offsets) > 0]
    plain = (raw > 0x20) & (raw != 0x7F)
    odd = np.flatnonzero((raw >= 0xC2) & _ODD[raw])
    for k in range(3):
        plain[odd[odd + k < total] + k] = False  # these characters, whole
    begins = np.zeros(total + 1, bool)
    begins[edges] = True
    cuts = []
    for sign in (0x20, 0x0A):
        at = np.flatnonzero(raw == sign)
        at = at[(at > 0) & (at < total - 1)]
        at = at[plain[at - 1] & plain[at + 1] & ~begins[at] & ~begins[at + 1]]  # what stands in another text is no neighbour
        cuts += [at] if sign == 0x20 else [at, at + 1]
    at = np.flatnonzero((raw >= 0x21) & (raw <= 0x3F) & _STOP[raw])
    at = at[at > 0]
    begins[at[_LETTER[raw[at - 1]]]] = True
    for at in cuts:
        begins[at] = True
    start = np.flatnonzero(begins[:total])
    ends = pa.py_buffer(np.append(start, total).astype(np.int64))
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, ends, pa.py_buffer(data)]).dictionary_encode()
    return np.asarray(column.indices), column.dictionary, np.searchsorted(start, offsets)


def _ranges(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin : begin + size] of each range, one after the other, and where each of them starts (and the last one ends)."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends


class Encoder:
    """A tokenizer, and the ids of pieces that it was asked for: piece k has ids[start[k] : start[k + 1]]."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(1 << 16, np.uint32), array("q", [0])

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # no offsets are asked for
        sizes = [len(x) for x in found]
        return np.fromiter(chain.from_iterable(found), np.uint32, sum(sizes)), sizes

    def whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and each text's number of them, by the library alone."""
        ids, sizes = self._ask([x or "" for x in column.to_pylist()])
        return ids, np.array(sizes, np.int64)

    def parted(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The same, each distinct piece encoded once."""
        which, names, before = pieces(column)
        names = names.to_pylist()
        missing = [x for x in names if x not in self.number]
        if len(self.number) + len(missing) > KEPT_PIECES:
            self._forget()
            missing = names
        for at in range(0, len(missing), 10_000):
            some = missing[at : at + 10_000]
            new, sizes = self._ask([x.decode() for x in some])
            end = self.start[-1]
            if end + len(new) > len(self.ids):
                self.ids = np.concatenate([self.ids[:end], np.zeros(end + 2 * len(new), np.uint32)])
            self.ids[end : end + len(new)] = new
            self.number.update(zip(some, range(len(self.start) - 1, len(self.start) - 1 + len(some))))
            self.start.extend((end + np.cumsum(sizes)).tolist())
        start = np.array(self.start)
        own = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        sizes = start[own + 1] - start[own]
        store, offset = _ranges(self.ids, start[own], sizes)  # of this column's pieces alone: small enough to stay near
        ids, ends = _ranges(store, offset[:-1][which], sizes[which])
        return ids, np.diff(ends[before])


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Once a worker. The path is one of the machine or image, as the library is."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def segments(docs: DataFrame, path: str, end_id: int = END_ID, parted: bool = True, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """SEGMENT rows in ascending order of (part, segment); ids are compressed 32-bit values."""
    spark = docs.sparkSession
    spread = F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_last("doc_id"), spread.asc()]
    dealt = docs.repartitionByRange(max(least, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)

    def task(batches):
        encode = encoder(path).parted if parted else encoder(path).whole
        part, number, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def segment():
            counts = [len(x) for x in ids]
            body = squeeze(np.concatenate(ids).astype("<u4").tobytes())
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_ids", "counts", "ids"])

        for block in cut_blocks(batches, "text", BLOCK):
            every, sizes = encode(block.column("text"))
            ends = np.cumsum(sizes).tolist()
            for doc, end, size in zip(block.column("doc_id").to_pylist(), ends, sizes.tolist()):
                held.append(doc)
                ids.append(np.append(every[end - size : end], np.uint32(end_id)))
                n += size + 1
                if n >= segment_ids:
                    yield segment()
                    number, held, ids, n = number + 1, [], [], 0
            release()
        if held:
            yield segment()

    return cut(dealt.mapInArrow(task, SEGMENT))


# -- codes -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code with at most `limit` bits (more, if there are more symbols), by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    own = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([own, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)  # which of the sorted items are symbols
        merged = weights[rank]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for symbol in reversed(levels):
        symbols = int(symbol[:take].sum())
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: numbered upwards by length, then by place."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    own = lengths[order]
    most = own[-1] if len(own) else 1
    spans = np.left_shift(1, most - own)  # values of `most` bits that begin with each code
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (np.cumsum(spans) - spans) >> (most - own)
    return codes


class Codebook:
    """Ids with their code lengths; both directions as tables."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.codes = canonical(self.lengths)
        self.packed = self.codes << U(8) | self.lengths.astype(U)
        self.by_id = np.zeros(int(self.ids.max()) + 1, np.uint64) if len(ids) and self.ids.max() < DENSE else None
        if self.by_id is not None:
            self.by_id[self.ids] = self.packed
        self.bits = int(self.lengths.max()) if len(ids) else 1

    def encode(self, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, bytes]:
        """(bit offset of each block, bits with eight zero bytes behind)."""
        packed = self.packed[np.searchsorted(self.ids, ids)] if self.by_id is None else self.by_id[ids]
        size, code = (packed & U(255)).astype(np.int64), packed >> U(8)
        ends = np.cumsum(size)
        begin = ends - size
        total = int(ends[-1]) if len(ids) else 0
        out = np.zeros(total // 64 + 2, np.uint64)
        word, room = begin >> 6, 64 - (begin & 63) - size  # bits left behind the code in its word, below zero where it runs over
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(U), code >> np.maximum(-room, 0).astype(U))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            out[word[first]] = np.add.reduceat(high, first)  # codes of a word share no bit
            over = np.flatnonzero(room < 0)  # at most one a word
            out[word[over] + 1] += code[over] << (64 + room[over]).astype(U)
        return begin[::block_ids], out.astype(">u8").tobytes()[: -(-total // 8)] + b"\0" * 8

    def table(self) -> np.ndarray:
        """For each value of the next `bits` bits: the id and, in the low byte, its length."""
        order = np.lexsort((self.ids, self.lengths))
        own = np.repeat(self.ids[order].astype(U) << U(8) | self.lengths[order].astype(U), 1 << (self.bits - self.lengths[order]))
        return np.append(own, np.ones((1 << self.bits) - len(own), U))  # the rest of a code of one symbol

    def decode(self, offsets: np.ndarray, bits: bytes, n: int, block_ids: int = BLOCK_IDS, table: np.ndarray | None = None) -> np.ndarray:
        """n ids: all blocks side by side, a look-up an id."""
        table = self.table() if table is None else table
        raw = np.frombuffer(bits, np.uint8)
        eight = np.ndarray((max(len(raw) - 7, 0),), np.dtype(">u8"), raw, strides=(1,))
        out = np.zeros((block_ids, len(offsets)), np.uint32)
        last = n - (len(offsets) - 1) * block_ids  # ids of the last block
        at = offsets.astype(np.int64).copy()
        for k in range(block_ids if len(offsets) > 1 else last):
            own = at if k < last else at[:-1]
            value = (eight[own >> 3].astype(np.uint64) << (own & 7).astype(U)) >> U(64 - self.bits)
            found = table[value]
            out[k, : len(own)] = found >> U(8)
            own += (found & U(255)).astype(np.int64)
        return out.T.ravel()[:n]


# -- files -----------------------------------------------------------------------------------------


def count_ids(segments: DataFrame) -> DataFrame:
    """(id, n) over all segments."""

    def task(batches):
        for batch in batches:
            for payload in batch.column("ids"):
                ids = np.frombuffer(unsqueeze(payload.as_py()), "<u4")
                if len(ids) and ids.max() < DENSE:
                    n = np.bincount(ids)
                    ids, n = np.flatnonzero(n), n[n > 0]
                else:
                    ids, n = np.unique(ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], ["id", "n"])

    return segments.select("ids").mapInArrow(task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, limit: int = LIMIT, parted: bool = True, segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS) -> None:
    """docs (doc_id, text) as token-id files in a folder that every executor reaches. tokenizer: the path of its file."""
    spark = docs.sparkSession
    parts = segments(docs, tokenizer, end_id, parted, segment_ids)
    counts = count_ids(parts).collect()  # at most a row for each id of the vocabulary
    ids, n = np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64)
    order = np.argsort(ids)
    book = Codebook(ids[order], code_lengths(n[order], limit))
    rows = list(zip(book.ids.tolist(), book.lengths.tolist()))
    spark.createDataFrame(rows, "id long, length int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    total = parts.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    start, at = {}, 0
    for r in total.orderBy("part").collect():  # a row a part
        start[r.part], at = at, at + r.n
    shared = spark.sparkContext.broadcast((book, start))

    def task(batches):
        book, start = shared.value
        part, at = None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                own = one.column("part")[0].as_py()
                if own != part:  # a task's segments come by part, in order
                    part, at = own, start[own]
                ids = np.frombuffer(unsqueeze(one.column("ids")[0].as_py()), "<u4")
                offsets, bits = book.encode(ids, block_ids)
                columns = [one.column("part"), one.column("segment"), pa.array([at], pa.int64()), one.column("doc_ids"), one.column("counts")]
                columns += [pa.array([offsets.astype("<u8").tobytes()], pa.binary()), pa.array([bits], pa.binary())]
                at += len(ids)
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CODED.split(", ")])

    parts.mapInArrow(task, CODED).write.mode("overwrite").parquet(f"{folder}/segments")


def read_ids(spark: SparkSession, folder: str, make: Callable[[list, np.ndarray, np.ndarray, int], pa.RecordBatch], schema: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token-id files again: make(doc_ids, counts, ids, start) gives a segment's rows of the result."""
    rows = spark.read.parquet(f"{folder}/codebook").collect()  # at most a row for each id of the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.length for r in rows], np.int64)))

    def task(batches):
        book = Codebook(*shared.value)
        table = book.table() if len(book.ids) else None
        for batch in batches:
            for start, docs, counts, offsets, bits in zip(*(batch.column(c) for c in ("start", "doc_ids", "counts", "offsets", "bits"))):
                counts = np.array(counts.as_py(), np.int64)
                ids = book.decode(np.frombuffer(offsets.as_py(), "<u8"), bits.as_py(), int(counts.sum()), block_ids, table)
                yield make(docs.as_py(), counts, ids, start.as_py())

    return spark.read.parquet(f"{folder}/segments").select("start", "doc_ids", "counts", "offsets", "bits").mapInArrow(task, schema)


def texts_of(spark: SparkSession, folder: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, start, ids) of token-id files; ids include the end id."""

    def make(docs, counts, ids, start):
        ends = np.cumsum(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), lists], ["doc_id", "start", "ids"])

    return read_ids(spark, folder, make, "doc_id long, start long, ids array<long>", block_ids)


def digests(spark: SparkSession, folder: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token-id files: crc32 of the ids as little-endian 32-bit values."""

    def make(docs, counts, ids, start):
        ends = np.cumsum(counts)
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_ids(spark, folder, make, "doc_id long, start long, n_tokens long, ids_crc32 long", block_ids)
