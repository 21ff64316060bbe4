"""Language-model scoring with a weighted backoff automaton of smoothed trigrams.

States are the contexts that training has seen: the root (no context), the text's start, each word, and each pair of words that
followed each other. A state h has an arc for every word w that followed it in training, with weight log10 P(w|h), and one failure
arc, with weight log10 of the mass that h leaves to its shorter context: from two words to the last of them, from one to the
root, which has an arc for every word. A text is scored in one traversal from left to right: at each word the present state's arc
is taken, or its failure arcs until there is one; the arc leads to the longest context that is a state.

Smoothing is by Dirichlet priors (MacKay and Peto, 1995): P(w|h) = (c(hw) + k P(w|h')) / (c(h) + k), h' the context without its first
word and k from `PRIOR`; at the root P(w) = (c(w) + 1) / (N + V + 1). So each state's probabilities sum to one, with one share for
all unknown words together, and an unseen word has k / (c(h) + k), the failure arc's mass, of what h' gives it.

The model is of the whole training side and grows with it; nothing of it is sent to every task. Words and pairs, and then triples,
are counted by block exchange (see blocks.py), by hashes of 64 bits that fall evenly on the buckets, however frequent a word is.
With the counts of its own n-grams a block has the part of the automaton that its texts can reach, and all places of its texts walk
there together: the state before a place is the longest known context there, and a walk is at most two failure arcs and one arc.

Two n-grams of n are taken for one with probability n**2 / 2**65: at 100 TB (some 10**12 different triples) for about 3 in 10**8 of them.

Defined cases: a null or empty text is the end token alone; rows that repeat are scored and counted each time; a null id
is in training (its crc32 is null); an empty training side gives the uniform share of unknown words; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import blocks as B
from quillon.llm.words import U, Words, mix
from quillon.shared import cut

ORDER = 3
#: Strength k of the prior at contexts of one and two words, in occurrences: log10 a token of held-out texts at sf0.1 is -3.88 with
#: these, -4.20 with (16, 8) and -3.92 with (1000, 300).
PRIOR = (1000.0, 30.0)
#: Orders that are counted together: the files of one turn are gone before the next.
TURNS = ((1, 2), (3,))
END, START = U(0x51ED270B0C7A4C9D), U(0xA3B195354A39B70D)
_PAIR, _TRIPLE = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, log_counts double, score double"


class _Grams:
    """A block's n-grams by order: sorted distinct hashes, own training counts, and the n-gram that ends at each place.

    A text's tokens are its words and one end. Order 1 also counts the start of each text; at a text's first place there is no
    triple, as the start is its whole context."""

    def __init__(self, block: pa.Table, orders: tuple[int, ...] = (1, 2, 3)):
        words = Words(block.column("text"), lower=True)
        self.train = np.asarray(block.column("train"))
        self.count = words.count + 1
        self.first = np.cumsum(self.count) - self.count
        n = len(words.start) + len(self.first)
        word = np.empty(n, U)
        last = self.first + words.count
        self.inner = np.ones(n, bool)
        self.inner[last] = False
        word[self.inner], word[last] = words.hashes(), END
        weight = np.repeat(self.train, self.count).astype(np.float64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first] = START
        self.inner[last] = True
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        pair = mix(word * _PAIR ^ mix(before))
        self.names, self.counts = [], []
        for order in orders:
            if order == 1:
                keys, own = np.concatenate([word, np.full(len(self.first), START, U)]), np.concatenate([weight, self.train.astype(np.float64)])
            elif order == 2:
                keys, own = pair, weight
            else:
                keys, own = mix(pair[at] * _TRIPLE ^ mix(before[at - 1])), weight[at]
            names, place = np.unique(keys, return_inverse=True)
            self.names.append(names)
            self.counts.append(np.bincount(place, own, len(names)).astype(np.int64))
            if order == 1:
                self.word, self.start = place[:n], place[n] if len(self.first) else 0
            elif order == 2:
                self.pair = place
            else:
                self.triple = np.zeros(n, np.int64)
                self.triple[at] = place

    def bounds(self, buckets: int) -> list[np.ndarray]:
        return [B.bucket_bounds(x, buckets) for x in self.names]


def _small(counts: np.ndarray) -> bytes:
    kind = np.uint8 if not len(counts) or counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _make(orders: tuple[int, ...], buckets: int):
    def make(payload: bytes) -> list[tuple[int, bytes]]:
        grams = _Grams(B.open_table(payload), orders)
        bounds, out = grams.bounds(buckets), []
        for b in range(buckets):
            parts = []
            for names, counts, edge in zip(grams.names, grams.counts, bounds):
                own = slice(edge[b], edge[b + 1])
                parts += [B.pack_sorted(names[own]), _small(counts[own])]
            out.append((b, B.join_parts(parts)))
        return out

    return make


def _reduce(orders: tuple[int, ...]):
    def reduce(bucket: int, payloads: list[bytes]) -> tuple[list[bytes], dict]:
        """Total counts of each block's n-grams; figures: kind 0 training tokens, 1 distinct training tokens."""
        parts = [B.split_parts(p) for p in payloads]
        answers: list[list[bytes]] = [[] for _ in payloads]
        figures: dict[str, list[int]] = {"kind": [], "n": []}
        for k, order in enumerate(orders):
            lists = [B.unpack_sorted(p[2 * k]) for p in parts]
            names, back = np.unique(np.concatenate(lists), return_inverse=True)
            total = np.bincount(back, np.concatenate([_large(p[2 * k + 1]) for p in parts]), len(names)).astype(np.int64)
            for a, place in zip(answers, np.split(back, np.cumsum([len(x) for x in lists])[:-1])):
                a.append(_small(total[place]))
            if order == 1:
                words = names != START
                figures = {"kind": [0, 1], "n": [int(total[words].sum()), int((total[words] > 0).sum())]}
        return [B.squeeze(B.join_parts(a)) for a in answers], figures

    return reduce


class _Automaton:
    """The part of the automaton that a block's texts reach: arcs are the block's n-grams that training has, states are their ends."""

    def __init__(self, grams: _Grams, totals: list[np.ndarray], n_train: int, n_types: int):
        one, two, three = (x.astype(np.float64) for x in totals)
        context, ends = np.zeros(len(two), np.int64), np.zeros(len(two), np.int64)  # of each pair: its first word (or the start), and its second
        before = np.empty_like(grams.word)
        before[1:] = grams.word[:-1]
        before[grams.first] = grams.start
        context[grams.pair], ends[grams.pair] = before, grams.word
        at = np.flatnonzero(grams.inner)
        head, tail = np.zeros(len(three), np.int64), np.zeros(len(three), np.int64)  # of each triple: its first and its second pair
        head[grams.triple[at]], tail[grams.triple[at]] = grams.pair[at - 1], grams.pair[at]
        k2, k3 = PRIOR
        p1 = (one + 1) / (n_train + n_types + 1)
        p2 = (two + k2 * p1[ends]) / (one[context] + k2)
        p3 = (three + k3 * p2[tail]) / (two[head] + k3)
        #: Weights of arcs (from the root, a word, a pair), whether training has the arc, and weights of failure arcs (from a word, a pair).
        self.arc = [np.log10(p) for p in (p1, p2, p3)]
        self.known = [np.ones(len(one), bool), two > 0, three > 0]
        self.fail = [np.log10(k2 / (one + k2)), np.log10(k3 / (two + k3))]
        self.is_state = [one > 0, two > 0]

    def walk(self, grams: _Grams) -> np.ndarray:
        """The log10 probability at each place: failure arcs from the state before it until one has an arc for its word."""
        n = len(grams.word)
        before_word, before_pair = np.empty(n, np.int64), np.empty(n, np.int64)
        before_word[1:], before_pair[1:] = grams.word[:-1], grams.pair[:-1]
        before_word[grams.first], before_pair[grams.first] = grams.start, 0
        order = np.where(grams.inner & self.is_state[1][before_pair], 2, np.where(self.is_state[0][before_word], 1, 0))
        total = np.zeros(n)
        for length, context, gram in ((2, before_pair, grams.triple), (1, before_word, grams.pair)):
            stands = order == length
            found = stands & self.known[length][np.minimum(gram, len(self.known[length]) - 1)] if len(self.known[length]) else np.zeros(n, bool)
            total[found] += self.arc[length][gram[found]]
            fails = stands & ~found
            total[fails] += self.fail[length - 1][context[fails]]
            order[found], order[fails] = -1, length - 1
        rest = order == 0
        total[rest] += self.arc[0][grams.word[rest]]
        return total


def _finish(n_train: int, n_types: int, buckets: int):
    def finish(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        block = B.open_table(payload)
        grams = _Grams(block)
        bounds = grams.bounds(buckets)
        totals = [np.zeros(len(x), np.int64) for x in grams.names]
        for turn, orders in enumerate(TURNS):
            for b in range(buckets):
                for order, part in zip(orders, B.split_parts(B.unsqueeze(B.reply(replies, turn * buckets + b)))):
                    edge = bounds[order - 1]
                    totals[order - 1][edge[b] : edge[b + 1]] = _large(part)
        count = totals[0][grams.word]
        steps = _Automaton(grams, totals, n_train, n_types).walk(grams)
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "train": block.column("train"),
                "n_tokens": grams.count.astype(np.int64),
                "n_known": np.add.reduceat((count > 0).astype(np.int64), grams.first),
                "log_counts": np.add.reduceat(np.log10(count + 1.0), grams.first),
                "score": np.add.reduceat(steps, grams.first),
            }
        )

    return finish


def score_texts(docs: DataFrame, train: Column, block_bytes: int | None = None) -> DataFrame:
    """Per row: n_tokens, n_known, log_counts (sum of log10(c+1) over its tokens), n_train and n_types of the model, and
    score, the log10 probability that the automaton gives to the text. `train` says which rows are learned from."""
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train"))
    sizes = B.plan(docs, block_bytes)
    blocks = B.cut_once(docs, sizes)
    turns = [cut(B.answer(B.send(blocks, _make(orders, sizes.buckets)), _reduce(orders), "kind long, n long")) for orders in TURNS]
    figures = {r.kind: r.n for r in turns[0].where("bucket = -1").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_train, n_types = figures.get(0, 0), figures.get(1, 0)
    parts = [x.where("bucket >= 0").withColumn("bucket", F.col("bucket") + F.lit(k * sizes.buckets)) for k, x in enumerate(turns)]
    out = B.meet(blocks, parts[0].unionByName(parts[1]), _finish(n_train, n_types, sizes.buckets), SCHEMA)
    return out.withColumns({"n_train": F.lit(n_train).cast("long"), "n_types": F.lit(n_types).cast("long")})


def base_score() -> Column:
    """The add-one unigram score of the rows of score_texts."""
    return F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("n_train") + F.col("n_types") + 1)


class BackoffAutomaton:
    """The same automaton over a small text collection, built of explicit states and arcs and walked one token at a time: the
    whole-corpus form is held against it. A state is a tuple of words, the longest last."""

    def __init__(self, texts: list[str | None]):
        self.arcs: dict[tuple, dict[bytes, int]] = {(): {}}
        for text in texts:
            history: tuple = (b" start",)
            for w in self.tokens(text):
                for k in range(len(history) + 1):
                    arcs = self.arcs.setdefault(history[k:], {})
                    arcs[w] = arcs.get(w, 0) + 1
                history = (*history, w)[1 - ORDER :]
        self.n, self.types = sum(self.arcs[()].values()), len(self.arcs[()])

    @staticmethod
    def tokens(text: str | None) -> list[bytes]:
        return [*(text or "").encode().lower().split(), b" end"]

    def probability(self, state: tuple, w: bytes) -> float:
        arcs = self.arcs.get(state, {})
        if not state:
            return (arcs.get(w, 0) + 1) / (self.n + self.types + 1)
        k = PRIOR[len(state) - 1]
        return (arcs.get(w, 0) + k * self.probability(state[1:], w)) / (sum(arcs.values()) + k)

    def longest(self, history: tuple) -> tuple:
        """The longest end of a history that is a state."""
        while history and history not in self.arcs:
            history = history[1:]
        return history

    def step(self, state: tuple, w: bytes) -> tuple[float, tuple]:
        """(log10 probability of w, next state): failure arcs until a state has an arc for w."""
        weight, at = 0.0, state
        while at and w not in self.arcs[at]:
            k = PRIOR[len(at) - 1]
            weight += math.log10(k / (sum(self.arcs[at].values()) + k))
            at = self.longest(at[1:])
        return weight + math.log10(self.probability(at, w)), self.longest((*state, w)[1 - ORDER :])

    def score(self, text: str | None) -> float:
        state, total = self.longest((b" start",)), 0.0
        for w in self.tokens(text):
            weight, state = self.step(state, w)
            total += weight
        return total
