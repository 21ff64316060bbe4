"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, and its LCP intervals.

The lines of a text that have a word, in order, are a sequence of line ids (a hash of the line without blanks at its
ends). Suffixes of all sequences are sorted by prefix doubling: round 0 ranks single lines, and a round from depth d to 2d
ranks each suffix by the pair (its rank, the rank of the suffix d lines on). Suffixes that share a rank at depth d are an
LCP interval of depth d: a run of d lines and all places where it starts. Rounds go on until no rank is shared, so the longest
repeated run has ended and the ranks, which keep the order of the ids, are the whole suffix array of the repeated lines. Lines
and suffixes that occur once leave at the first round that tells.

The least place (document id, line number) of an interval keeps its lines; any other place is a later copy, and keeps the depth of
its deepest interval and the interval's least place as its source. Depths up to min_words are all tried (those between powers of two
as two overlapping ranks), beyond it powers of two. A later copy's run is deleted if it has `min_words` words or more. As every
line has a word, the run of a copy of more than min_words lines is the union of the intervals along it. Copies whose places and
sources follow each other are one maximal run, a row of `runs`.

A round is one block exchange (see blocks.py): blocks send each distinct pair once, with its number and least place, so a
line that a third of all documents hold costs one entry a block; buckets answer with the new rank, whether the run repeats,
and where its least place is. Pairs are dealt by ranges of both ranks, cut where a sample of the blocks' pairs is dealt evenly: what
follows a frequent line is parted among many buckets. A rank is its bucket in the high bits and an offset below, so no global sums are
needed. Blocks without a shared rank take no part in later rounds.

Defined cases: null and blank texts have no lines; rows that share an id share its line numbers, so the lesser number is the
earlier; a null id comes after all others (a run's source is null there); equal places keep their lines; `apply` carries other
columns as they are and drops the rows of which copies left fewer than `LEAST_LEFT` words (texts that lost nothing stay, however short).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import blocks as B
from quillon.llm.rows import sealed
from quillon.llm.words import U, Words
from quillon.shared import cut

MIN_WORDS = 8
#: Words that must be left of a text that lost lines, for `apply` to keep its row: as many as the quality rules ask for.
LEAST_LEFT = 10
LAST = np.iinfo(np.int64).max
_RUN = "struct<start:long,stop:long,source_id:long,source_start:long>"
SCHEMA = f"doc_id long, n_lines long, n_removed long, n_chars_removed long, kept_text string, runs array<{_RUN}>"
_PA_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "source_id", "source_start")]))
#: In the column bucket of a block's state: no rank is shared any more, or some are.
_DONE, _SHARED = -1, -2
#: Rows of a sample, and sampled pairs of all blocks together (four a block at least).
_SAMPLE, SAMPLES = -3, 1 << 16
#: What deals a round: a number of buckets for hashes, or the borders (first, second) between buckets of pairs.
Edges = int | tuple[np.ndarray, np.ndarray]
_NEWLINE = np.arange(256) == 0x0A
_SHIFT = U(40)


def _lines(block: pa.Table) -> dict:
    """A block's lines: text, number in the text, words, and a hash without the blanks at the ends."""
    lines = Words(block.column("text"), blank=_NEWLINE)
    words = Words(block.column("text"))
    a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    filled = b > a
    text = lines.text[filled]
    lines.start, lines.end = words.start[a[filled]], words.end[b[filled] - 1]
    count = np.bincount(text, minlength=len(lines.count))
    return {
        "count": count,
        "text": text.astype(np.int32),
        "number": (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32),
        "words": (b - a)[filled].astype(np.int32),
        "hash": lines.hashes(),
        "span": np.stack([lines.start, lines.end], 1),
    }


def _state(block: pa.Table) -> dict:
    lines = _lines(block)
    doc = np.asarray(block.column("doc_id").fill_null(LAST)).astype(np.int64)
    n = len(lines["text"])
    own = {"doc": doc, "total": n, "at": np.arange(n, dtype=np.int32), **{k: lines[k] for k in ("text", "number", "words", "hash")}}
    return own | {"depth": np.zeros(n, np.int32), "source": np.zeros(n, np.int64), "source_start": np.zeros(n, np.int32)}


def _pairs(state: dict, step: int | None, depths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lists to rank: (positions, first keys, second keys). step None: single lines; else depths d by the ranks at `step`."""
    if step is None:
        return [(np.arange(len(state["hash"])), state["hash"], np.zeros(len(state["hash"]), U))]
    rank, out = state[f"rank{step}"], []
    active = rank != 0
    for depth in depths:
        n = len(rank) - (depth - step)
        at = np.arange(max(n, 0))
        on = at + depth - step
        ok = active[at] & active[on] & (state["text"][at] == state["text"][on]) & (state["number"][on] - state["number"][at] == depth - step)
        out.append((at[ok], rank[at[ok]], rank[on[ok]]))
    return out


def _groups(state: dict, first: np.ndarray, second: np.ndarray, at: np.ndarray):
    """Order of the positions by key and place, start of each distinct key in it, and group of each position in that order."""
    doc, number = state["doc"][state["text"][at]], state["number"][at]
    order = np.lexsort((number, doc, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _bounds(first: np.ndarray, second: np.ndarray, step: int | None, edges: Edges) -> np.ndarray:
    """Borders of the buckets in sorted pairs. Single lines are dealt by their hash, pairs by ranges of both ranks: pairs that share a
    frequent first line are parted too."""
    if step is None:
        return B.bucket_bounds(first, edges)
    low, high = np.searchsorted(first, edges[0], "left"), np.searchsorted(first, edges[0], "right")
    own = [a + int(np.searchsorted(second[a:b], s)) if b > a else a for a, b, s in zip(low.tolist(), high.tolist(), edges[1])]
    return np.concatenate([[0], np.array(own, np.int64), [len(first)]])


def _sampled(state: dict, step: int, depths: tuple[int, ...], size: int) -> bytes:
    """Up to `size` of the distinct pairs that a block sends in a round: of pairs at even steps of the texts, those at even steps of
    their own order."""
    even = lambda n, k: np.unique(np.linspace(0, n - 1, min(n, k)).astype(np.int64)) if n else np.zeros(0, np.int64)
    pairs = [np.stack([first, second])[:, even(len(first), 16 * size)] for _, first, second in _pairs(state, step, depths)]
    own = np.unique(np.concatenate([*pairs, np.zeros((2, 0), U)], 1), axis=1)
    return own[:, even(own.shape[1], size)].tobytes()


def _edges(samples: list[bytes], buckets: int) -> Edges:
    """Borders between the buckets that deal the sampled pairs evenly; a pair is in the bucket of its last border at or below it."""
    pairs = np.concatenate([*(np.frombuffer(x, U).reshape(2, -1) for x in samples), np.zeros((2, 0), U)], 1)
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    if not pairs.shape[1]:
        return np.zeros(0, U), np.zeros(0, U)
    cuts = pairs[:, np.arange(1, buckets) * pairs.shape[1] // buckets]
    new = np.ones(cuts.shape[1], bool)
    new[1:] = (cuts[:, 1:] != cuts[:, :-1]).any(0)
    return cuts[0][new], cuts[1][new]


def _send(step: int | None, depths: tuple[int, ...], edges: Edges):
    def make(state: dict) -> list[tuple[int, bytes]]:
        out: dict[int, list] = {}
        for k, (at, first, second) in enumerate(_pairs(state, step, depths)):
            order, start, _ = _groups(state, first, second, at)
            head = order[start]
            count = np.diff(np.append(start, len(order)))
            keys = first[head]
            place = at[head]
            bounds = _bounds(keys, second[head], step, edges)
            for b in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[b], bounds[b + 1])
                p = place[own]
                body = (keys[own], second[head][own], (count[own] > 1).astype(np.uint8), state["doc"][state["text"][p]], state["number"][p])
                out.setdefault(int(b), []).append((k, body))
        return [(b, B.squeeze(pickle.dumps(x, 5))) for b, x in out.items()]

    def task(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                entries = make(pickle.loads(B.unsqueeze(payload)))
                if entries:
                    yield B._rows([(block, bucket, x) for bucket, x in entries])

    return task


def _reduce(step: int | None, n_lists: int):
    def reduce(bucket: int, payloads: list[bytes]) -> tuple[list[bytes], dict]:
        sent = [dict(pickle.loads(B.unsqueeze(p))) for p in payloads]
        answers: list[dict] = [{} for _ in payloads]
        for k in range(n_lists):
            having = [i for i, x in enumerate(sent) if k in x]
            if not having:
                continue
            first, second, many, doc, number = (np.concatenate([sent[i][k][c] for i in having]) for c in range(5))
            order = np.lexsort((number, doc, second, first))
            new = np.ones(len(order), bool)
            new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            least = order[start][group]
            later, repeats = np.zeros(len(order), bool), np.zeros(len(order), bool)
            later[order] = (doc[least] < doc[order]) | ((doc[least] == doc[order]) & (number[least] < number[order]))
            repeats[order] = ((np.diff(np.append(start, len(order))) > 1) | (np.add.reduceat(many[order].astype(np.int64), start) > 0))[group]
            rank = np.zeros(len(order), U)
            rank[order] = (U(bucket) << _SHIFT) + (start[group] + 1).astype(U)
            rank[~repeats] = 0
            lengths = np.cumsum([len(sent[i][k][0]) for i in having])[:-1]
            place = np.zeros(len(order), np.int64)
            place[order] = least
            for i, r, x, p in zip(having, *(np.split(v, lengths) for v in (rank, later, place))):
                answers[i][k] = (r, np.packbits(x), doc[p[x]], number[p[x]])
        return [B.squeeze(pickle.dumps(a, 5)) for a in answers], {}

    return reduce


def _update(step: int | None, depths: tuple[int, ...], edges: Edges, coming: tuple[int, tuple[int, ...]], samples: int):
    """The state after a round: ranks of the new depth, depths and sources of later copies, and only lines that repeat. Beside it a
    sample of the pairs of the coming round."""

    def update(state: dict, replies: dict[int, bytes]) -> dict:
        opened = {b: pickle.loads(B.unsqueeze(x)) for b, x in replies.items()}
        for k, (depth, (at, first, second)) in enumerate(zip(depths, _pairs(state, step, depths))):
            order, start, group = _groups(state, first, second, at)
            bounds = _bounds(first[order[start]], second[order[start]], step, edges)
            rank, later = np.zeros(len(start), U), np.zeros(len(start), bool)
            doc, number = state["doc"][state["text"][at[order]]], state["number"][at[order]]
            source, source_start = doc[start], number[start]  # a block's least place of each run, or the bucket's if that is earlier
            for b in np.flatnonzero(np.diff(bounds)):
                if k not in opened.get(int(b), {}):
                    raise RuntimeError("a block has no answer from a bucket: its answers are not whole")
                r, bits, least_doc, least_number = opened[int(b)][k]
                own = slice(bounds[b], bounds[b + 1])
                rank[own], later[own] = r, np.unpackbits(bits, count=len(r)).astype(bool)
                earlier = bounds[b] + np.flatnonzero(later[own])
                source[earlier], source_start[earlier] = least_doc, least_number
            ranks = np.zeros(len(state["hash"]), U)
            ranks[at[order]] = rank[group]
            head = start[group]  # in a block, all but the least place are later; the least is so if the bucket says it
            late = later[group] | (doc > doc[head]) | (number > number[head])
            place = at[order][late]
            state["depth"][place], state["source"][place], state["source_start"][place] = depth, source[group[late]], source_start[group[late]]
            if step is None or depth == 2 * step:
                state[f"rank{depth}"] = ranks
        if step is None:
            stay = state["rank1"] != 0
            for key in ("at", "text", "number", "words", "hash", "rank1", "depth", "source", "source_start"):
                state[key] = state[key][stay]
        return state

    def group(table: pa.Table) -> pa.Table:
        replies, states = {}, []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
            if bucket < 0:
                states.append(payload)
            else:
                replies[bucket] = payload
        block, out = table.column("block")[0].as_py(), []
        for payload in states:
            state = update(pickle.loads(B.unsqueeze(payload)), replies)
            shared = (state[f"rank{depths[-1]}"] != 0).any()
            out.append((block, _SHARED if shared else _DONE, B.squeeze(pickle.dumps(state, 5))))
            if shared:
                out.append((block, _SAMPLE, _sampled(state, *coming, samples)))
        return pa.Table.from_batches([B._rows(out)])

    return group


def _runs(state: dict, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, start, stop, source id, source start) of the maximal runs of later copies, as far as they have min_words words."""
    own = np.flatnonzero(state["depth"])
    text, number, depth, at = state["text"][own], state["number"][own].astype(np.int64), state["depth"][own].astype(np.int64), state["at"][own]
    sums = np.concatenate([[0], np.cumsum(state["all_words"])])
    long = sums[at + depth] - sums[at] >= min_words
    text, number, depth, source, begin = text[long], number[long], depth[long], state["source"][own][long], state["source_start"][own][long].astype(np.int64)
    if not len(text):
        return text, number, number, source, begin
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1] + 1) | (source[1:] != source[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(number + depth, first)
    key = text[first].astype(np.int64) << 32
    reach = np.maximum.accumulate(key + stop)
    inside = np.zeros(len(first), bool)  # of a run that began before
    inside[1:] = (key + stop)[1:] <= reach[:-1]
    first, stop = first[~inside], stop[~inside]
    return text[first], number[first], stop, source[first], begin[first]


def _kept(block: pa.Table, replies: dict[int, bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, list[str], list[list[dict]]]:
    """Lines, removed lines, the text that stays, and the runs of later copies, of each row."""
    state = pickle.loads(B.unsqueeze(B.reply(replies, 0)))
    lines = _lines(block)
    state["all_words"] = lines["words"]
    runs: list[list[dict]] = [[] for _ in range(block.num_rows)]
    cover = np.zeros(state["total"] + 1, np.int64)
    before = np.cumsum(lines["count"]) - lines["count"]
    for text, start, stop, source, begin in zip(*(x.tolist() for x in _runs(state, min_words))):
        runs[text].append({"start": start, "stop": stop, "source_id": None if source == LAST else source, "source_start": begin})
        cover[before[text] + start] += 1
        cover[before[text] + stop] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    borders = np.concatenate([[0], np.cumsum(lines["count"])])
    n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[borders])
    texts = [x or "" for x in block.column("text").to_pylist()]
    for i in np.flatnonzero(n_removed):
        raw = texts[i].split("\n")
        filled = [k for k, x in enumerate(raw) if not _blank(x)]
        out = {filled[k] for k in np.flatnonzero(gone[borders[i] : borders[i + 1]])}
        texts[i] = "\n".join(x for k, x in enumerate(raw) if k not in out)
    return lines["count"].astype(np.int64), n_removed.astype(np.int64), texts, runs


def _texts_left(min_words: int):
    def finish(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        block = B.open_table(payload)
        n_lines, n_removed, texts, runs = _kept(block, replies, min_words)
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "n_lines": n_lines,
                "n_removed": n_removed,
                "n_chars_removed": pa.array([len(a or "") - len(b) for a, b in zip(block.column("text").to_pylist(), texts)], pa.int64()),
                "kept_text": pa.array(texts, pa.string()),
                "runs": pa.array(runs, _PA_RUNS),
            }
        )

    return finish


def _rows_left(min_words: int, least_left: int):
    def finish(payload: bytes, replies: dict[int, bytes]) -> pa.Table:
        block = B.open_table(payload)
        _, n_removed, texts, _ = _kept(block, replies, min_words)
        new = {"text": pa.array([x if n else old for x, n, old in zip(texts, n_removed, block.column("text").to_pylist())], block.schema.field("text").type)}
        if "n_chars" in block.column_names:
            old = block.column("n_chars").to_pylist()
            new["n_chars"] = pa.array([len(x) if n else was for x, n, was in zip(texts, n_removed, old)], block.schema.field("n_chars").type)
        for name, column in new.items():
            block = block.set_column(block.column_names.index(name), name, column)
        return block.filter(pa.array((n_removed == 0) | (Words(block.column("text")).count >= least_left)))

    return finish


def _blank(line: str) -> bool:
    return not line.encode().split()


def rounds(min_words: int) -> Iterator[tuple[int | None, tuple[int, ...]]]:
    """(depth of the ranks that are paired, new depths) of each round, without an end: every depth up to min_words, then powers of two."""
    yield None, (1,)
    for power in count():
        depth = 1 << power
        yield depth, (*range(depth + 1, min(2 * depth - 1, min_words) + 1), 2 * depth)


def suffix_ranks(blocks: DataFrame, sizes: B.Plan, min_words: int = MIN_WORDS) -> DataFrame:
    """Per block its state after all rounds. rank1, rank2, rank4, ... of it hold each repeated line's rank at that depth (0: the run
    occurs once): sorted by rank the lines are the suffix array to that depth, and equal ranks are its LCP intervals."""
    lots = max(8, sizes.buckets // 4)
    samples, edges = max(4, SAMPLES // sizes.buckets), lots
    state = cut(B.send(blocks, lambda payload: [(_SHARED, B.squeeze(pickle.dumps(_state(B.open_table(payload)), 5)))]))
    done = state.where(F.col("bucket") == _DONE)
    for (step, depths), coming in pairwise(rounds(min_words)):
        answers = B.answer(state.mapInArrow(_send(step, depths, edges), B.ROW), _reduce(step, len(depths)))
        after = cut(state.unionByName(answers).groupBy("block").applyInArrow(_update(step, depths, edges, coming, samples), B.ROW))
        done, state = done.unionByName(after.where(F.col("bucket") == _DONE)), after.where(F.col("bucket") == _SHARED)
        sampled = [bytes(r.payload) for r in after.where(F.col("bucket") == _SAMPLE).select("payload").collect()]  # some SAMPLES pairs
        if not sampled:
            return done
        edges = _edges(sampled, lots)


def _run(docs: DataFrame, finish, schema, min_words: int, block_bytes: int | None) -> DataFrame:
    sizes = B.plan(docs, block_bytes)
    blocks = B.cut_once(docs, sizes)
    state = suffix_ranks(blocks, sizes, min_words)
    return B.meet(blocks, state.withColumn("bucket", F.lit(0)), finish, schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, block_bytes: int | None = None) -> DataFrame:
    """Per row: n_lines, n_removed, n_chars_removed, the text without later copies of runs of lines (null: empty), and these runs as
    line numbers (end exclusive, lines without words not counted), each with the document and line where it stands first."""
    return _run(docs.select("doc_id", "text"), _texts_left(min_words), SCHEMA, min_words, block_bytes)


def apply(docs: DataFrame, min_words: int = MIN_WORDS, least_left: int = LEAST_LEFT, block_bytes: int | None = None) -> DataFrame:
    """docs, all columns whatever their names are, with the text (and n_chars, if there) that stays. Rows that lost lines and have
    fewer than least_left words left go: what remains of a copy is no document."""
    docs, names = sealed(docs)
    return _run(docs, _rows_left(min_words, least_left), docs.schema, min_words, block_bytes).toDF(*names)
