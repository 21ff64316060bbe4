"""Spelling variants: words at edit distance one, found by Aho-Corasick automata over both halves of every word.

A word is cut into two segments, the first half of its code points and the rest. If another word differs by one inserted, deleted
or replaced code point, that edit lies in one segment and the other segment stands unchanged in the other word: the first one at its
start, the last one at its end. So each word's two segments go into automata, each word is scanned by them, a match counts if its
offset and the two lengths agree, and the distance of what is left is verified.

Scale: words are counted in blocks of text (a hot word is one row a block) and only words that are long and frequent enough go on.
Automata are sharded by a hash of (side, segment). A word is scanned by the shards that can hold a segment standing at its start or its
end: the segments of words one code point shorter or longer have at most two lengths a side, so a word is in at most four shards, and
work grows with the number of words. A shard holds at most `SHARD` segments; where the hash deals more to one (many words that share a
half), its segments are dealt again to parts, each of which scans the shard's words, in slices: memory stays bounded, nothing is left
out. In a shard, words under one segment are found by the halves of what is left of them, and so on until few remain.

Forms: of a word's near words the one of largest count, if that is `FACTOR` times its own. Counts grow by that factor along forms, so
they have no cycles and end after log(largest count) steps; roots are found by pointer doubling.

Defined cases: null and empty texts have no words; in rows without an id no code point is deleted; every row counts, repeated rows too;
words of one spelling are one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import cut_blocks, release
from quillon.llm.words import LOWER, Words
from quillon.shared import cut

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Of the runs of a text, those whose crc32 this divides lose a code point.
DROP_EVERY = 31
BLOCK = 8 << 20
#: Segments of an automaton, and segments that a shard is planned for.
SHARD, PLANNED = 200_000, 50_000
#: Words under one segment up to which each is compared.
FEW = 24
HEAD, TAIL = 0, 1


# -- words of texts --------------------------------------------------------------------------------


def _zero_step() -> np.ndarray:
    """crc32's table: the checksum of a byte, for one more byte behind it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_STEP = _zero_step()


def _shifts(longest: int) -> np.ndarray:
    """[length, byte, value]: what each byte of a checksum becomes under so many more zero bytes (crc32 is linear)."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = _STEP[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


class Runs(Words):
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), lower-cased in A-Z. U+00C0 to U+00FF are the characters of lead byte 0xC3."""

    def __init__(self, column):
        from quillon.llm.words import text_bytes

        data, offsets = text_bytes(column)
        self.data, self.offsets, total = LOWER[data], offsets, len(data) - 8
        raw = self.data[:total]
        lead = raw == 0xC3
        solid = lead | ((raw >= 0x61) & (raw <= 0x7A))
        solid[1:] |= lead[:-1]
        self.lead = np.concatenate([[0], np.cumsum(lead)])
        first = np.zeros(total + 1, bool)
        first[offsets] = True
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:total]
        stops[:-1] &= ~solid[1:] | first[1:total]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.before = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.before)

    def points(self) -> np.ndarray:
        """Code points of each run."""
        return self.end - self.start - (self.lead[self.end] - self.lead[self.start])

    def keep(self, some: np.ndarray) -> None:
        self.text_of = self.text[some]
        self.start, self.end = self.start[some], self.end[some]


def _without(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def counted(block: pa.Table, least_length: int) -> dict[str, int]:
    """Words of a block's texts, with their numbers: runs, less a code point in those that crc32 picks."""
    runs = Runs(block.column("text"))
    runs.keep(runs.points() >= least_length)  # a shorter run gives no word
    if not len(runs.start):
        return {}
    _, head, word = np.unique(runs.hashes(), return_index=True, return_inverse=True)
    raw = runs.data.tobytes()
    words = [raw[a:b] for a, b in zip(runs.start[head].tolist(), runs.end[head].tolist())]
    size = np.array([len(w) for w in words], np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    ids = block.column("doc_id")
    begun = np.array([zlib.crc32(f"{d}:".encode()) for d in ids.fill_null(0).to_pylist()], np.uint32)[runs.text_of]
    # crc32 of id and word, from the two: words of the same length move the id's checksum alike
    crc = np.zeros(len(word), np.uint32)
    order = np.argsort(size[word], kind="stable")
    borders = np.flatnonzero(np.diff(size[word][order], prepend=-1, append=-1))
    tables = dict(enumerate(_shifts(min(int(size.max()), 64))))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        at = order[a:b]
        n = int(size[word[at[0]]])
        table = tables[n] if n in tables else _far_shift(n)
        c = begun[at]
        crc[at] = table[0, c & 255] ^ table[1, c >> 8 & 255] ^ table[2, c >> 16 & 255] ^ table[3, c >> 24] ^ own[word[at]]
    known = np.asarray(ids.is_valid())[runs.text_of]
    hit = (crc % DROP_EVERY == 0) & known
    texts = [w.decode() for w in words]
    out: dict[str, int] = {}
    for k, n in enumerate(np.bincount(word[~hit], minlength=len(words)).tolist()):
        if n:
            out[texts[k]] = out.get(texts[k], 0) + n
    for k, h in zip(word[hit].tolist(), crc[hit].tolist()):
        changed = _without(texts[k], h % len(texts[k]))
        if len(changed) >= least_length:
            out[changed] = out.get(changed, 0) + 1
    return out


def _far_shift(n: int) -> np.ndarray:
    """_shifts(n)[n], by doubling: for very long runs."""
    base, out = _shifts(1)[1], _shifts(0)[0]
    apply = lambda t, c: t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]
    while n:
        if n & 1:
            out = apply(base, out)
        base, n = apply(base, base), n >> 1
    return out


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with least_length code points and least_count occurrences in all texts."""

    def task(batches):
        for block in cut_blocks(batches, "text", BLOCK):
            found = counted(block, least_length)
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[x] for x in names], pa.int64())], ["word", "n"])
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- near words ------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def looked_up(length: int) -> list[tuple[int, int]]:
    """(side, segment length) of the segments that a near word of a word of this length can share with it."""
    lengths = (length - 1, length, length + 1)
    return sorted({(HEAD, n // 2) for n in lengths} | {(TAIL, n - n // 2) for n in lengths})


class Rests:
    """What is left of words that share a segment. Few are compared one by one; of many, those are that share a half of it too."""

    def __init__(self, rests: list[tuple[str, int]]):
        self.few = rests if len(rests) <= FEW or min(len(r) for r, _ in rests) < 2 else None
        self.by_half: dict = {}
        if self.few is None:
            groups: dict = {}
            for rest, word in rests:
                first, last = halves(rest)
                groups.setdefault((len(rest), HEAD, first), []).append((last, word))
                groups.setdefault((len(rest), TAIL, last), []).append((first, word))
            self.by_half = {key: Rests(x) for key, x in groups.items()}

    def find(self, rest: str) -> Iterator[int]:
        """The words whose rest differs from this one by one edit; a word can come more than once."""
        if self.few is not None:
            yield from (word for other, word in self.few if near(rest, other))
            return
        for n in (len(rest) - 1, len(rest), len(rest) + 1):
            cut = n // 2
            if n < 1:
                continue
            if under := self.by_half.get((n, HEAD, rest[:cut])):
                yield from under.find(rest[cut:])
            tail = n - cut
            if tail <= len(rest) and (under := self.by_half.get((n, TAIL, rest[len(rest) - tail :]))):
                yield from under.find(rest[: len(rest) - tail])


class Shard:
    """One automaton over segments; its values are the words under each segment, by side and by the length of their rest."""

    def __init__(self, segments: Iterable[tuple[int, str, str, int]]):
        """segments: (side, segment, word, count of the word)."""
        under: dict[str, dict] = {}
        self.words: list[tuple[str, int]] = []
        for side, segment, word, n in segments:
            rest = word[len(segment) :] if side == HEAD else word[: len(word) - len(segment)]
            under.setdefault(segment, {}).setdefault((side, len(rest)), []).append((rest, len(self.words)))
            self.words.append((word, n))
        self.automaton = ahocorasick.Automaton()
        for segment, rests in under.items():
            self.automaton.add_word(segment, (len(segment), {key: Rests(x) for key, x in rests.items()}))
        if under:
            self.automaton.make_automaton()

    def scan(self, word: str) -> dict[str, int]:
        """The near words (and their counts) that share a segment of this shard with the word: a match has to start where the word
        starts or to end where it ends, and leave a rest whose length is one off at most."""
        out: dict[str, int] = {}
        if not self.words:
            return out
        for end, (size, rests) in self.automaton.iter(word):
            for side, at_place in ((HEAD, end + 1 == size), (TAIL, end + 1 == len(word))):
                if not at_place:
                    continue
                rest = word[size:] if side == HEAD else word[: len(word) - size]
                for n in (len(rest) - 1, len(rest), len(rest) + 1):
                    if (side, n) in rests:
                        found = (self.words[k] for k in rests[side, n].find(rest))
                        # a pair that shares the first segment too is told by that
                        out.update((other, x) for other, x in found if side == HEAD or not word.startswith(halves(other)[0]))
        return out


def _best(found: dict[str, int]) -> tuple[str, int]:
    return min(found.items(), key=lambda x: (-x[1], x[0]))


def dealt(words: DataFrame, shards: int) -> DataFrame:
    """(shard, asks, side, segment, word, n): each word's two segments, and the word once for each shard that scans it."""
    length, word = F.length("word"), F.col("word")
    cut_at = F.floor(length / 2).cast("int")
    head = lambda n: F.substring(word, F.lit(1), n)
    tail = lambda n: F.substring(word, length - n + 1, n)
    entry = lambda asks, side, segment: F.struct(F.lit(asks).alias("asks"), F.lit(side).alias("side"), segment.alias("segment"))
    own = [entry(False, HEAD, head(cut_at)), entry(False, TAIL, tail(length - cut_at))]
    asked = [entry(True, HEAD, head(F.floor((length + d) / 2).cast("int"))) for d in (-1, 1)]
    asked += [entry(True, TAIL, tail(length + d - F.floor((length + d) / 2).cast("int"))) for d in (-1, 1)]  # n // 2 of the length itself is one of the two
    rows = words.select("word", "n", F.explode(F.array_distinct(F.array(*own, *asked))).alias("e")).select("word", "n", "e.*")
    return rows.withColumn("shard", F.pmod(F.xxhash64("side", "segment"), F.lit(shards)).cast("int"))


def near_words(words: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """(word, n_near, best, best_n): how many near words a word has among the others, and which of them counts most."""
    total = words.count()
    shards = max(4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // PLANNED))
    rows = dealt(words, shards)
    over = lambda c: F.when(F.col(c) > shard_size, F.ceil(F.col(c) / (shard_size / 2))).otherwise(1).cast("int").alias(c)
    counts = rows.groupBy("shard").agg(F.count_if(~F.col("asks")).alias("parts"), F.count_if("asks").alias("slices"))
    large = counts.where(F.greatest("parts", "slices") > shard_size).select("shard", over("parts"), over("slices"))  # few shards, or none
    rows = rows.join(large, "shard", "left").fillna(1, ["parts", "slices"])
    one = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n).cast("long")).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("part", F.explode(F.when(F.col("asks"), each("parts")).otherwise(one("parts"))))
    rows = rows.withColumn("slice", F.explode(F.when(F.col("asks"), one("slices")).otherwise(each("slices"))))

    def scan(table: pa.Table) -> pa.Table:
        asks, side, segment, word, n = (table.column(c).to_pylist() for c in ("asks", "side", "segment", "word", "n"))
        shard = Shard((s, x, w, k) for a, s, x, w, k in zip(asks, side, segment, word, n) if not a)
        out = [(w, len(found), *_best(found)) for w in dict.fromkeys(w for a, w in zip(asks, word) if a) if (found := shard.scan(w))]
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("word", "n_near", "best", "best_n"), columns, kinds)})

    found = rows.select("shard", "part", "slice", "asks", "side", "segment", "word", "n").groupBy("shard", "part", "slice").applyInArrow(scan, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


# -- groups ----------------------------------------------------------------------------------------


def _rooted(words: DataFrame) -> DataFrame:
    """words (word, form, ...) with root: the last of the forms from each word on, by pointer doubling."""
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(most) / math.log(FACTOR))  # forms in a row, as each counts FACTOR times as much
    step = words.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        far = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(far, "root").select("word", F.col("next").alias("root")))
    return words.join(step, "word")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, shard_size: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, each with its more frequent spelling and the last of these."""
    if least_length < 2:
        raise ValueError("a word of one code point has no two segments")
    words = cut(vocabulary(docs, least_length, least_count))
    found = words.join(near_words(words, shard_size), "word", "left")
    ok = F.col("best_n") >= FACTOR * F.col("n")
    formed = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n")))
    return _rooted(formed).select("word", "form", "root", "n", "n_near", "form_n")
