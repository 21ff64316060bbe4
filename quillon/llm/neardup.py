"""Near-duplicate classes by SetSketch registers: bands find candidates, a likelihood joins them, full sets confirm.

A text is the set of its distinct 5-word shingles (lower-case; under five words: the whole as one). Its sketch has 192
registers floor(c - log_b(m)), m the least of exponential variates of the shingles, b = 1.1: truncated, exponentially spaced
minima. The sketch of a union is the register-wise maximum, and registers of two sets agree the likelier the more
similar they are (SetSketch: Ertl, 2021).

1. Equal sets fall together by a 128-bit fingerprint and cost one row from here on, however many copies there are.
2. 32 bands of 6 registers; a pair at similarity 0.85 shares no band with probability (1 - 0.856**6)**32 < 1e-7. Buckets of
   the same members are looked at once.
3. In a bucket the joint likelihood of (equal, greater, less) register counts and the known set sizes estimates the
   similarity. A search that compares a reached set with unreached ones only gives each member one edge to a seed of
   its estimated class: estimates of 0.70 or more join. A pair at 0.85 has a lower one with probability under 5e-8 (summed over
   all register counts in the tests), so bands and estimate together lose it with probability under 2e-7.
4. Components of these edges are candidate classes. The full shingle sets of a class meet once, and links of 100 * |A & B|
   >= 85 * |A | B| are confirmed on them exactly, pair by pair until the class is one component or all pairs that could
   still join two components have been compared.

Equal texts are one row in steps 2 to 4. A bucket of over MOST_IN_BUCKET sketches, or a class of over MOST_IN_CLASS sets, is dealt
to blocks of which each two meet in a task of bounded size (graph.spread); the parts are joined by the nodes they share.

Defined cases: a text without words has the empty set, is linked with nothing, and is its own component; a row without an id
links others but gives no id to a component (a component of such rows alone has a null id); rows that share an id are
separate rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import cut_blocks
from quillon.llm.graph import components, spread, stream_groups
from quillon.llm.rows import sealed
from quillon.llm.words import U, Words, mix, rolling, runs
from quillon.shared import cut

WIDTH, REGISTERS, BANDS, BASE, OFFSET = 5, 192, 32, 1.1, 31.0
LINK, JOIN = 85, 0.70
MOST_IN_BUCKET, MOST_IN_CLASS = 200_000, 20_000
BLOCK = 4 << 20
SKETCH_SCHEMA = "doc_id long, row long, n_shingles long, node long, check long, sketch binary"
_A = (mix(np.arange(1, REGISTERS + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_C = (mix(np.arange(REGISTERS + 1, 2 * REGISTERS + 1, dtype=U)) >> U(32)).astype(np.uint32)
_SALT = mix(np.arange(1, BANDS + 1, dtype=U))


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    words = Words(texts, lower=True)
    codes = words.hashes()
    h = rolling(codes, WIDTH)
    sets = []
    for a, b in zip(words.before[:-1], words.before[1:]):
        if b - a >= WIDTH:
            sets.append(np.unique(h[a : b - WIDTH + 1]))
        else:
            sets.append(rolling(codes[a:b], b - a) if b > a else h[:0])
    borders = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else h[:0]), borders


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sketch (uint8) of each set; sets start at `first` and are not empty."""
    least = np.empty((REGISTERS, len(first)), np.uint32)
    low = hashes.astype(np.uint32)
    ends = np.append(first[1:], len(low))
    at = 0
    while at < len(first):  # parts that stay in the cache
        to = max(at + 1, int(np.searchsorted(ends, first[at] + 65536, "right")))
        part, inner = low[first[at] : ends[to - 1]], first[at:to] - first[at]
        room = np.empty_like(part)
        for i in range(REGISTERS):
            np.multiply(part, _A[i], out=room)
            room += _C[i]
            np.minimum.reduceat(room, inner, out=least[i, at:to])
        at = to
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(OFFSET - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)


def _sketch_task(batches):
    for block in cut_blocks(batches, "text", BLOCK):
        hashes, borders = shingle_sets(block.column("text"))
        size = np.diff(borders)
        full = np.flatnonzero(size)
        first = borders[:-1][full]
        node, check = np.asarray(block.column("row")).astype(np.int64), np.zeros(len(size), np.int64)  # empty sets: spread, never joined
        sketches: list[bytes | None] = [None] * len(size)
        if len(full):
            node[full] = np.add.reduceat(mix(hashes), first).astype(np.int64)
            check[full] = np.add.reduceat(mix(hashes ^ _SALT[0]), first).astype(np.int64)
            for i, sketch in zip(full, registers(hashes, first)):
                sketches[i] = sketch.tobytes()
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").combine_chunks().cast(pa.int64()), block.column("row").combine_chunks(), pa.array(size), pa.array(node), pa.array(check), pa.array(sketches, pa.binary())],
            ["doc_id", "row", "n_shingles", "node", "check", "sketch"],
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _band_task(batches):
    for batch in batches:
        parts = np.zeros((batch.num_rows, BANDS, 8), np.uint8)
        parts[:, :, : REGISTERS // BANDS] = _matrix(batch.column("sketch")).reshape(batch.num_rows, BANDS, -1)
        keys = mix(parts.reshape(batch.num_rows, -1).view("<u8") ^ _SALT)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(np.asarray(batch.column("node")), BANDS))], ["key", "node"])


def estimate(sketch: np.ndarray, size: float, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of one set with others, from register comparisons and the set sizes."""
    greater, less = (sketch > others).sum(1), (sketch < others).sum(1)
    equal = REGISTERS - greater - less
    u = (size / (size + sizes))[:, None]
    grid = np.linspace(0.0, 1.0, 81)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    step = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = step(u - (1 - u) * grid), step((1 - u) - u * grid)
    likelihood = greater[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


def _near(sketch, size, others, sizes) -> np.ndarray:
    """Estimates of JOIN or more; sizes and the share of equal registers rule most others out first."""
    able = np.minimum(size, sizes) >= JOIN * np.maximum(size, sizes)
    able[able] = (sketch == others[able]).sum(1) >= 0.65 * REGISTERS
    able[able] = estimate(sketch, size, others[able], sizes[able]) >= JOIN
    return able


def _bucket_task(batches):
    for group in stream_groups(batches, "key"):
        node, order = np.unique(np.asarray(group.column("node")), return_index=True)
        sketch, size = _matrix(group.column("sketch"))[order], np.asarray(group.column("n_shingles"))[order].astype(np.float64)
        left, pairs = np.arange(len(node)), []
        while len(left) > 1:
            seed, left = left[0], left[1:]
            reached = [seed]
            while reached and len(left):
                at = reached.pop()
                near = _near(sketch[at], size[at], sketch[left], size[left])
                pairs.append(np.stack([np.full(near.sum(), node[seed]), node[left[near]]]))
                reached.extend(left[near])
                left = left[~near]
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        if both.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _set_task(batches):
    for block in cut_blocks(batches, "text", BLOCK):
        hashes, borders = shingle_sets(block.column("text"))
        sets = [hashes[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]
        yield pa.RecordBatch.from_arrays([block.column(c).combine_chunks() for c in ("root", "n", "node")] + [pa.array(sets, pa.binary())], ["root", "n", "node", "members"])


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set under 100 * |A & B| >= LINK * |A | B|: the index of a member.

    Each set in turn is held against all sets of other components that it has not met; sets that reach most others come
    first, by how common their shingles are in the class, so a class around one original closes after a few turns."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    codes = np.unique(every, return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    common = np.add.reduceat(np.bincount(codes)[codes], first) / sizes
    component, done, marked = np.arange(len(sets)), np.zeros(len(sets), bool), np.zeros(codes.max() + 1, bool)
    for at in np.argsort(-common, kind="stable"):
        if (component == component[0]).all():
            break
        own = codes[first[at] : first[at] + sizes[at]]
        marked[own] = True
        shared = np.add.reduceat(marked[codes].astype(np.int64), first)
        marked[own] = False
        near = (100 * shared >= LINK * (sizes + sizes[at] - shared)) & ~done
        done[at] = True
        joined = np.unique(component[near])
        component[np.isin(component, joined)] = min(component[at], joined.min()) if len(joined) else component[at]
    return component


def _solve_task(batches):
    for group in stream_groups(batches, "root"):
        node, order = np.unique(np.asarray(group.column("node")), return_index=True)
        members = group.column("members").combine_chunks()
        component = linked([np.frombuffer(members[int(i)].as_py(), U) for i in order])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[component])], ["node", "label"])


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's set (doc_id, row, n_shingles, node, check), and each set's label, least id and least row."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = cut(docs.mapInArrow(_sketch_task, SKETCH_SCHEMA))
    place = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    nodes = rows.where("n_shingles > 0").groupBy("node", "check", "n_shingles").agg(place.alias("least"), F.min("row").alias("row"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes)
    bands = nodes.select("node", "sketch").mapInArrow(_band_task, "key long, node long")
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("node") % (1 << 40)).alias("s"), F.bit_xor("node").alias("x")).where("n > 1")
    buckets = buckets.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    members = spread(bands.join(buckets, "key"), "key", "n", "node", MOST_IN_BUCKET).join(nodes.select("node", "n_shingles", "sketch"), "node")
    edges = members.repartition("key").sortWithinPartitions("key").select("key", "node", "n_shingles", "sketch").mapInArrow(_bucket_task, "a long, b long")
    roots = components(edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    places = roots.join(sizes, "root")
    texts = docs.join(nodes.select("row", "node").join(places, "node"), "row").select("root", "n", "node", "text")
    sets = spread(texts.mapInArrow(_set_task, "root long, n long, node long, members binary"), "root", "n", "node", MOST_IN_CLASS)
    labels = sets.repartition("root").sortWithinPartitions("root").mapInArrow(_solve_task, "node long, label long")
    if not sizes.where(F.col("n") > MOST_IN_CLASS).isEmpty():  # parts of one class are joined by the nodes they share
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))).withColumnRenamed("root", "label")
    return rows.drop("sketch"), cut(nodes.select("node", "check", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: n_shingles, component_id (the least doc_id that links reach), kept (doc_id is component_id)."""
    rows, labelled = _classes(docs)
    least = labelled.groupBy("label").agg(F.min("least.doc_id").alias("component"))
    answers = labelled.join(least, "label").select("node", "check", "component")
    out = rows.drop("row").join(answers, ["node", "check"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def apply(docs: DataFrame) -> DataFrame:
    """docs, all columns whatever their names are: of each component one row stays, that of the least id (rows without an id come
    last). Of rows with equal id and text one stays, the least by a hash of all its columns; they are brought together before the
    join, a task's own copies first. Rows without words all stay."""
    rows, labelled = _classes(docs)
    kept = labelled.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.row").alias("key"))
    kept = kept.unionByName(rows.where("n_shingles = 0").select(F.col("row").alias("key"))).distinct()
    whole, names = sealed(docs)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = whole.select(F.xxhash64("doc_id", "text").alias("key"), F.when(has_words, F.lit(-1)).otherwise(F.monotonically_increasing_id()).alias("lone"), F.xxhash64(*whole.columns).alias("order"), F.struct(*whole.columns).alias("all"))
    return keyed.groupBy("key", "lone").agg(F.min_by("all", "order").alias("all")).join(kept, "key", "left_semi").select("all.*").toDF(*names)
