"""Block exchange: count, over a whole corpus, hashes that are made in numpy, and bring the answers back to the texts.

Rows of (hash, document) for every token or window would cost more shuffle than the text itself. Instead the rows are cut
once into blocks of text, which stand in the shared checkpoint folder and are all that later steps read. A block combines
equal hashes (so a hot hash costs one entry a block, however often it occurs), and sends each range of the hash space
("bucket") one compact sorted run. A bucket meets the runs of all blocks, sums them and answers each block in that block's own
order. Last, a block and its answers meet again under the block's id, a hash of its content.

Scale: both the block and the bucket hold about `block_bytes` of text. It is at least 8 MB and grows with the square
root of the input, so that a (block, bucket) run never falls below some 16 entries (100 TB: blocks of about 100 MB), and
memory a task stays at a small multiple of it. As blocks are stored, it does not matter how a later read would split the
input: executors may come and go between the steps. A block whose answers are missing raises an error and never passes silently.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.shared import cut

ROW = "block long, bucket int, payload binary"
LEAST, MOST = 8 << 20, 256 << 20


class Plan:
    """Sizes of blocks and number of buckets for an input."""

    def __init__(self, total_bytes: int, block_bytes: int | None = None):
        self.block_bytes = block_bytes or min(MOST, max(LEAST, math.isqrt(96 * max(total_bytes, 1))))
        self.buckets = max(8, -(-2 * total_bytes // (3 * self.block_bytes)))


#: Bytes of text a byte of a table's files is taken for. Only sizes of blocks and numbers of buckets follow from it.
TEXT_A_BYTE = 2


def plan(docs: DataFrame, block_bytes: int | None = None) -> Plan:
    """From the sizes of the files that docs reads (their names and sizes alone are read), else from the texts' lengths."""
    try:
        files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
        total = TEXT_A_BYTE * (files.agg(F.sum("size")).first()[0] or 0)
    except AnalysisException:  # docs is not a plain read of files
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return Plan(total, block_bytes)


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator is left alone
    _libc = None


def release() -> None:
    """Gives freed memory back to the system after a block, so a worker holds its present block only."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def cut_blocks(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[pa.Table]:
    """Tables of whole rows, each of about block_bytes of text (one row may be longer)."""
    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, done + block_bytes - held)), at + (not held))
            to = min(to, batch.num_rows)
            if to > at:
                waiting.append(batch.slice(at, to - at))
                held += int(ends[to - 1] - done)
            at = to
            if at < batch.num_rows or held >= block_bytes:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, held = [], 0
                release()
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()
    release()


def block_id(block: pa.Table) -> int:
    """From the content alone: any task that reads these rows gets the same id."""
    digest = xxhash.xxh3_64(str(block.num_rows).encode())
    for column in block.columns:
        for chunk in column.chunks:
            part = pa.concat_arrays([chunk])
            for buffer in part.buffers():
                if buffer is not None:
                    digest.update(buffer)
    return int(np.uint64(digest.intdigest()).astype(np.int64))


def bucket_bounds(ordered: np.ndarray, buckets: int, low_bits: int = 0) -> np.ndarray:
    """Borders of the buckets in a sorted array of hashes: bucket b has the b-th part of the hash space. Hashes that differ
    in their low_bits only are never parted."""
    edges = np.array([(b << 64) // buckets >> low_bits << low_bits for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences of as many bytes as the largest needs."""
    if not len(values):
        return b"\x08"
    steps = np.diff(values, prepend=values[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    if len(packed) <= 9:
        return np.zeros(0, np.uint64)
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    values = steps.view("<u8").ravel().astype(np.uint64)
    values[0] = int.from_bytes(packed[1:9], "little")
    return np.cumsum(values, dtype=np.uint64)


def join_parts(parts: list[bytes]) -> bytes:
    return len(parts).to_bytes(2, "little") + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(payload: bytes) -> list[bytes]:
    parts, at = [], 2
    for _ in range(int.from_bytes(payload[:2], "little")):
        n = int.from_bytes(payload[at : at + 8], "little")
        parts.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


_squeeze, _unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _squeeze.compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return _unsqueeze.decompress(raw)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "bucket", "payload"]
    )


def pack_table(block: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(block)
    return sink.getvalue().to_pybytes()


def open_table(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def cut_once(docs: DataFrame, sizes: Plan, state: Callable[[pa.Table], bytes] = pack_table) -> DataFrame:
    """The blocks of docs (block, bucket -1, payload state(block)), computed once into the shared checkpoint."""
    block_bytes = sizes.block_bytes

    def task(batches):
        for block in cut_blocks(batches, "text", block_bytes):
            yield _rows([(block_id(block), -1, state(block))])

    return cut(docs.mapInArrow(task, ROW))


def send(blocks: DataFrame, make: Callable[[bytes], list[tuple[int, bytes]]]) -> DataFrame:
    """Each block's entries: make(payload) gives (bucket, payload) pairs."""

    def task(batches):
        for batch in batches:
            for own, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                entries = make(payload.as_py())
                if entries:
                    yield _rows([(own, bucket, x) for bucket, x in entries])
                release()

    return blocks.mapInArrow(task, ROW)


def answer(sent: DataFrame, reduce: Callable[[int, list[bytes]], tuple[list[bytes], dict]], extra: str = "") -> DataFrame:
    """Each bucket's answers. reduce(bucket, payloads) gives one answer a payload, and figures for the `extra` columns, which
    come in rows of their own (bucket -1)."""
    names = [x.split()[0] for x in extra.split(",")] if extra else []

    def group(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        answers, figures = reduce(bucket, table.column("payload").to_pylist())
        if names:
            some = list(figures.get(names[0], []))
            blocks, answers, buckets = [*blocks, *[0] * len(some)], [*answers, *[None] * len(some)], [bucket] * len(blocks) + [-1] * len(some)
        else:
            buckets = [bucket] * len(blocks)
        columns = {"block": pa.array(blocks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "payload": pa.array(answers, pa.binary())}
        for name in names:
            values = list(figures.get(name, []))
            columns[name] = pa.array([None] * (len(blocks) - len(values)) + values, pa.int64())
        release()
        return pa.table(columns)

    return sent.groupBy("bucket").applyInArrow(group, ROW + (", " + extra if extra else ""))


def meet(blocks: DataFrame, answers: DataFrame, finish: Callable[[bytes, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """Blocks again, each with its answers: finish(payload, {bucket: answer}) gives the block's rows of the result."""

    def group(table: pa.Table) -> pa.Table:
        replies, own = {}, []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload")):
            if bucket < 0:
                own.append(payload)
            else:
                replies[bucket] = payload.as_py()
        if not own:
            raise RuntimeError("a block's answers came without the block")
        out = pa.concat_tables([finish(payload.as_py(), replies) for payload in own])
        release()
        return out

    return blocks.unionByName(answers.select("block", "bucket", "payload")).groupBy("block").applyInArrow(group, schema)


def reply(replies: dict[int, bytes], bucket: int) -> bytes:
    if bucket not in replies:
        raise RuntimeError("a block has no answer from a bucket: its answers are not whole")
    return replies[bucket]
