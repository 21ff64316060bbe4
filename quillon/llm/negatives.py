"""Hard-negative mining by distributed radix selection.

Vectors become integer codes, so scores are integers and a rank is a place in a total order: higher scores first, ties by the
smaller id. Each anchor asks for its best `n_positives` rows of its own label (one window of all scores), and each anchor and
positive for the best `n_negatives` rows of other labels whose score lies in a window below the positive's. No scores are sorted or
shuffled for that. A pass over the rows counts each window's scores by their leading digit (a histogram of 256 buckets an open
window); Spark sums the histograms, and the bucket that holds the k-th row becomes the next pass's interval. Where so many rows tie
at one score that the bucket stays large, the digits of the ids follow. A window is settled when its bucket holds at most
`GATHER` rows: one more pass then gathers the rows above the bucket and in it, and only these are ranked.

Scale: anchors are read in turns of at most `TURN` anchors and `TURN_BYTES` of codes, which is all that is broadcast; every turn meets
all rows in numpy blocks, and its result stands in the shared checkpoint folder before the next one starts. A task sends a window's
buckets only as far as its own k-th row: the k-th of all rows is never behind it. So a task sends at most k rows a window, the driver
reads at most k a window, and a vector or label that a third of all rows hold changes nothing.

Defined cases: rows without an id, a label or a vector, or with a component that is null, not finite or of 2**31/256 or more in
size take no part; of rows that share an id the least label, then the least vector counts, once; a shorter vector is filled up with
zeros; a score of 2**62 or more in size stands in no window; windows of positives below zero are empty; no anchors or no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.shared import cut

ANCHOR_EVERY, FLIP_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST_PART, MOST_PART = 50, 95
SCALE, CODE_LIMIT = 256, 1 << 31
TURN, TURN_BYTES = 2048, 32 << 20
DIGIT_BITS, GATHER = 8, 64
BUCKETS = 1 << DIGIT_BITS
SLICE = 512
#: Parts of a result that are united before they are stored as one.
PARTS = 64
_NO_ID = np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def coded(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, codes): the rows that take part, one an id, in the shared checkpoint folder."""
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < CODE_LIMIT / SCALE))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    flipped = F.when(vec_id % FLIP_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), embeddings.count() // 50_000)
    rows = rows.select(vec_id.alias("vec_id"), flipped.alias("label"), codes.alias("codes")).repartition(parts, "vec_id")
    return cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("row")).select("vec_id", "row.label", "row.codes"))


def _matrix(column, width: int, exact: bool) -> np.ndarray:
    """Codes as a matrix, filled up with zeros: of doubles where products and sums are exact in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(column), width), np.float64 if exact else np.int64)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = np.asarray(column.flatten())
    return out


@dataclass
class Shape:
    """Of the coded table: what bounds the scores and the ids."""

    width: int
    exact: bool
    norm: int
    least_id: int
    most_id: int

    @classmethod
    def of(cls, rows: DataFrame) -> Shape:
        square = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        row = rows.agg(F.max(F.size("codes")).alias("w"), F.max(F.array_max(F.transform("codes", lambda x: F.abs(x.cast("long"))))).alias("top"), F.max(square).alias("sq"), F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
        width, top = row.w or 0, row.top or 0
        exact = width * top * top < 1 << 53
        return cls(width, exact, math.isqrt(int(row.sq or 0)) + 2 if exact else 1 << 31, row.a or 0, row.b or 0)


@dataclass
class Turn:
    """Some anchors: ids, labels and codes."""

    ids: np.ndarray
    label: np.ndarray
    codes: np.ndarray

    def of(self, some: np.ndarray) -> Turn:
        return Turn(self.ids[some], self.label[some], self.codes[some])


def turns(rows: DataFrame, shape: Shape, every: int) -> Iterator[Turn]:
    """The anchors in ascending order, at most TURN and TURN_BYTES at a time."""
    size = max(1, min(TURN, TURN_BYTES // max(1, 8 * shape.width)))
    held: list = []
    dtype = np.float64 if shape.exact else np.int64

    def turn() -> Turn:
        codes = np.zeros((len(held), shape.width), dtype)
        for k, r in enumerate(held):
            codes[k, : len(r.codes)] = r.codes
        return Turn(np.array([r.vec_id for r in held], np.int64), np.array([r.label for r in held], np.int64), codes)

    for row in cut(rows.where(F.col("vec_id") % every == 0).orderBy("vec_id")).toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield turn()
            held = []
    if held:
        yield turn()


@dataclass
class Asked:
    """Windows in layers, an array a field with one entry a layer and anchor. A window wants its best `need` rows with scores in
    (low, top]; known so far: rows above `high` are among them, `left` more come from the bucket (floor, high], by score or, once
    by_id, by the ids in [id_from, id_to) at the one score `high`."""

    same: bool
    low: np.ndarray
    top: np.ndarray
    need: int
    floor: np.ndarray
    high: np.ndarray
    left: np.ndarray
    by_id: np.ndarray
    id_from: np.ndarray
    id_to: np.ndarray
    open: np.ndarray

    @classmethod
    def new(cls, same: bool, low: np.ndarray, top: np.ndarray, need: int, shape: Shape) -> Asked:
        full = lambda x: np.full(low.shape, x, np.int64)
        return cls(same, low, top, need, low.copy(), top.copy(), full(need), np.zeros(low.shape, bool), full(shape.least_id), full(shape.most_id + 1), top > low)

    def of(self, some: np.ndarray) -> Asked:
        own = {k: v[:, some] for k, v in vars(self).items() if isinstance(v, np.ndarray)}
        return replace(self, **own)

    def shift(self) -> np.ndarray:
        """Bits below the digit that the next pass counts by. Widths are differences, so 64 bits without a sign hold them."""
        width = np.where(self.by_id, (self.id_to - self.id_from).view(np.uint64), (self.high - self.floor).view(np.uint64))
        bits = np.zeros(width.shape, np.int64)
        rest = np.maximum(width, 1) - np.uint64(1)
        while rest.any():
            bits += rest > 0
            rest = rest >> np.uint64(1)
        return np.maximum(0, bits - DIGIT_BITS)


def _scores(batches, shape: Shape, turn: Turn, same: bool):
    """(ids, scores, whether the row may stand in the anchor's windows) of a slice of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            ids, label = np.asarray(part.column("vec_id")), np.asarray(part.column("label"))
            scores = _matrix(part.column("codes"), shape.width, shape.exact) @ turn.codes.T
            alike = label[:, None] == turn.label
            yield ids, scores.astype(np.int64), alike & (ids[:, None] != turn.ids) if same else ~alike


def _digits(ids: np.ndarray, scores: np.ndarray, may: np.ndarray, asked: Asked, shift: np.ndarray, layer: int) -> np.ndarray:
    """Histogram of a slice: digits by anchor."""
    r, c = np.nonzero(may & (scores <= asked.high[layer]) & (scores > asked.floor[layer]) & asked.open[layer])
    if asked.by_id[layer].any():
        tied = asked.by_id[layer][c]
        inside = ~tied | ((ids[r] >= asked.id_from[layer][c]) & (ids[r] < asked.id_to[layer][c]))
        r, c = r[inside], c[inside]
    by_score, by_id = asked.high[layer][c] - scores[r, c], ids[r] - asked.id_from[layer][c]
    far = np.where(asked.by_id[layer][c], by_id, by_score).view(np.uint64) >> shift[layer][c].astype(np.uint64)
    return np.bincount(c * BUCKETS + far.astype(np.int64), minlength=scores.shape[1] * BUCKETS)


def histograms(rows: DataFrame, shape: Shape, turn: Turn, asked: Asked) -> DataFrame:
    """(window, digit, n) of the open windows' next digits, up to the bucket with the last row that a window wants. Window w is anchor
    w % anchors of layer w // anchors."""
    shared = rows.sparkSession.sparkContext.broadcast((turn, asked, asked.shift()))

    def task(batches):
        turn, asked, shift = shared.value
        layers, anchors = asked.low.shape
        total = np.zeros((layers, anchors * BUCKETS), np.int64)
        for ids, scores, may in _scores(batches, shape, turn, asked.same):
            for layer in range(layers):
                total[layer] += _digits(ids, scores, may, asked, shift, layer)
        total = total.reshape(layers * anchors, BUCKETS)
        before = np.cumsum(total, 1) - total
        window, digit = np.nonzero((total > 0) & (before < asked.left.reshape(-1, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[window, digit])], ["window", "digit", "n"])

    counts = rows.mapInArrow(task, "window int, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < asked.need)


def narrowed(asked: Asked, shift: np.ndarray, found: DataFrame) -> Asked:
    """The windows after a pass: each open one's interval is now the bucket that holds the last row it wants."""
    anchors = asked.low.shape[1]
    digit, inside, before = (np.full(asked.low.shape, x, np.int64) for x in (-1, 0, 0))
    for r in found.orderBy("window", "digit").collect():  # at most `need` rows a window
        at = divmod(r.window, anchors)
        if r.before < asked.left[at]:
            digit[at], inside[at], before[at] = r.digit, r.n, r.before
    new = replace(asked, **{k: v.copy() for k, v in vars(asked).items() if isinstance(v, np.ndarray)})
    for at in zip(*np.nonzero(asked.open)):
        if digit[at] < 0 or before[at] + inside[at] < asked.left[at]:  # fewer rows than wanted: all of the interval are
            new.open[at] = False
            continue
        step = 1 << int(shift[at])
        far = int(digit[at]) * step
        new.left[at] -= before[at]
        if asked.by_id[at]:
            new.id_from[at] = asked.id_from[at] + far
            new.id_to[at] = min(int(asked.id_to[at]), int(asked.id_from[at]) + far + step)
            width = int(new.id_to[at]) - int(new.id_from[at])
        else:
            new.high[at] = int(asked.high[at]) - far
            new.floor[at] = max(int(asked.floor[at]), int(asked.high[at]) - far - step)
            width = int(new.high[at]) - int(new.floor[at])
        new.open[at] = inside[at] > GATHER and (width > 1 or not asked.by_id[at])
        if new.open[at] and width == 1 and not asked.by_id[at]:
            new.by_id[at] = True
    return new


def gathered(rows: DataFrame, shape: Shape, turn: Turn, asked: Asked) -> DataFrame:
    """(window, vec_id, score, rank): each settled window's best `need` rows. Rows above its last bucket and in it alone leave the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((turn, asked))

    def task(batches):
        turn, asked = shared.value
        layers, anchors = asked.low.shape
        limit = np.where(asked.by_id, asked.id_to, _NO_ID)
        for ids, scores, may in _scores(batches, shape, turn, asked.same):
            for layer in range(layers):
                r, c = np.nonzero(may & (scores <= asked.top[layer]) & (scores > asked.floor[layer]))
                inside = (scores[r, c] > asked.high[layer][c]) | (ids[r] < limit[layer][c]) | ~asked.by_id[layer][c]
                r, c = r[inside], c[inside]
                yield pa.RecordBatch.from_arrays([pa.array((c + layer * anchors).astype(np.int32)), pa.array(ids[r]), pa.array(scores[r, c])], ["window", "vec_id", "score"])

    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(task, "window int, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.need)


def select(rows: DataFrame, shape: Shape, turn: Turn, asked: Asked) -> DataFrame:
    """Radix selection: passes over the open windows' anchors until every window is settled, then one gathering pass."""
    while asked.open.any():
        some = np.flatnonzero(asked.open.any(0))
        own = asked.of(some)
        after = narrowed(own, own.shift(), histograms(rows, shape, turn.of(some), own))
        for k, v in vars(after).items():
            if isinstance(v, np.ndarray):
                vars(asked)[k][:, some] = v
    return gathered(rows, shape, turn, asked)


def _turn(rows: DataFrame, shape: Shape, turn: Turn, n_positives: int, n_negatives: int, parts: tuple[int, int]) -> DataFrame:
    n = len(turn.ids)
    if shape.exact:
        bound = np.array([math.isqrt(int(x)) + 2 for x in (turn.codes**2).sum(1)], np.int64) * shape.norm
    else:
        bound = np.full(n, (1 << 62) - 1, np.int64)
    positives = select(rows, shape, turn, Asked.new(True, -bound[None] - 1, bound[None], n_positives, shape))
    least, most = parts
    low, top = np.zeros((n_positives, n), np.int64), np.full((n_positives, n), -1, np.int64)
    ids, score = np.zeros((n_positives, n), np.int64), np.zeros((n_positives, n), np.int64)
    for r in positives.collect():  # at most n_positives rows an anchor of the turn
        at = (r["rank"] - 1, r.window)
        ids[at], score[at] = r.vec_id, r.score
        if r.score >= 0:
            low[at], top[at] = -(-least * r.score // 100) - 1, most * r.score // 100
    asked = Asked.new(False, low, top, n_negatives, shape)
    found = select(rows, shape, turn, asked)
    shared = rows.sparkSession.sparkContext.broadcast((turn.ids, ids, score))

    def named(batches):
        anchor, ids, score = shared.value
        for batch in batches:
            layer, at = np.divmod(np.asarray(batch.column("window")), len(anchor))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(ids[layer, at]), batch.column("rank"), batch.column("vec_id"), pa.array(score[layer, at]), batch.column("score")], [x.split()[0] for x in RESULT.split(", ")])

    return found.mapInArrow(named, RESULT)


def mine(embeddings: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, every: int = ANCHOR_EVERY, parts: tuple[int, int] = (LEAST_PART, MOST_PART)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). embeddings: (vec_id, embedding, label). Anchors
    are the ids divisible by `every`; negatives score between `parts` hundredths of their positive."""
    rows = coded(embeddings)
    shape = Shape.of(rows)
    done: list[DataFrame] = []
    for turn in turns(rows, shape, every):
        done.append(cut(_turn(rows, shape, turn, n_positives, n_negatives, parts)))
        if len(done) == PARTS:
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done) if done else rows.sparkSession.createDataFrame([], RESULT)
