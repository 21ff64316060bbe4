"""The best rows of each query while a task reads its batches: what leaves a task is n rows a query, however many rows it has read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of scores that are looked at together, and rows of a batch that leaves.
CELLS, ROWS = 1 << 20, 1 << 19
LAST = np.iinfo(np.int64).max


class Best:
    """Of `queries` queries, numbered from 0, the best n rows met so far: by score, then by the keys (integers, least first)."""

    def __init__(self, queries: int, n: int, keys: int):
        self.n = n
        self.score = np.full((queries, n), -np.inf)
        self.keys = [np.full((queries, n), LAST, np.int64) for _ in range(keys)]

    def add(self, query: np.ndarray, score: np.ndarray, *keys: np.ndarray) -> None:
        """Scored rows, of any queries in any order."""
        live = np.flatnonzero((score >= self.score[query, -1]) & np.isfinite(score))
        if not len(live):
            return
        query, score, keys = query[live], score[live], [k[live] for k in keys]
        own = np.unique(query)
        query = np.concatenate([query, np.repeat(own, self.n)])
        score = np.concatenate([score, self.score[own].ravel()])
        keys = [np.concatenate([k, held[own].ravel()]) for k, held in zip(keys, self.keys)]
        order = np.lexsort((*reversed(keys), -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.n
        query, place, order = query[kept], place[kept], order[kept]
        self.score[query, place] = score[order]
        for held, k in zip(self.keys, keys):
            held[query, place] = k[order]

    def add_matrix(self, query: np.ndarray, scores: np.ndarray, *keys: np.ndarray) -> None:
        """scores: a row for each of `query`, a column for each row met; -inf or nan where there is none. Callers keep it near CELLS."""
        least = self.score[query, -1]
        wanted = scores >= least[:, None]
        if scores.shape[1] > self.n and np.count_nonzero(wanted) > 2 * self.n * len(query):
            at = scores.shape[1] - self.n
            own = np.partition(np.where(np.isfinite(scores), scores, -np.inf), at, axis=1)[:, at]
            wanted = scores >= np.maximum(least, own)[:, None]
        row, column = np.nonzero(wanted)
        self.add(query[row], scores[row, column], *[k[column] for k in keys])

    def batches(self, ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows (query_id, score, keys..) under `names`."""
        step = max(1, ROWS // self.n)
        for a in range(0, len(ids), step):
            row, place = np.nonzero(np.isfinite(self.score[a : a + step]))
            columns = [ids[a + row], self.score[a + row, place], *[k[a + row, place] for k in self.keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
