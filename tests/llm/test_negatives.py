"""Hard-negative mining against sorting all scores."""

import math
import random

import numpy as np
import pytest

from quillon.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, window string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def plainly(rows, n_positives=N.POSITIVES, n_negatives=N.NEGATIVES, every=N.ANCHOR_EVERY, parts=(N.LEAST_PART, N.MOST_PART)):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        one[i] = min(one.get(i, key), key)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, codes) in one.items():
        if a % every:
            continue
        scored = sorted((-score(codes, c), i, own == label) for i, (own, c) in one.items() if i != a)
        for p, pid, _ in [x for x in scored if x[2]][:n_positives]:
            found = [(s, i) for s, i, alike in scored if not alike and parts[0] * -p <= 100 * -s <= parts[1] * -p][:n_negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(n, width=8, labels=4, seed=3):
    r = random.Random(seed)
    return [(k, [r.gauss(0, 0.4) for _ in range(width)], r.randrange(labels)) for k in range(n)]


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, no numbers, other lengths, repeated rows and ids, negative ids, and one vector on a third of the rows."""
    rows = vectors(240)
    common = rows[3][1]
    rows += [(1000 + k, common, k % 3) for k in range(160)]
    rows += [(None, common, 1), (700, None, 1), (701, common, None), (702, [None] * 8, 1), (703, [float("nan")] * 8, 1), (704, [float("inf")] + [0.0] * 7, 2), (705, [], 1), (706, [0.5, 0.25], 2)]
    return rows + [rows[50], rows[50], (60, common, 0), (-50, common, 1), (-7, common, 2), (800, [0.0] * 8, 3)]


def test_equals_sorting(spark, odd):
    want = plainly(odd)
    assert len(want) > 40 and got(N.mine(frame(spark, odd))) == want


def test_large_buckets_are_refined_by_score_and_id(spark, odd, monkeypatch):
    monkeypatch.setattr(N, "GATHER", 2)
    monkeypatch.setattr(N, "TURN", 3)
    monkeypatch.setattr(N, "PARTS", 2)
    assert got(N.mine(frame(spark, odd))) == plainly(odd)


def test_other_parameters(spark):
    rows = vectors(150, 5)
    assert got(N.mine(frame(spark, rows), 2, 7, 10, (10, 100))) == plainly(rows, 2, 7, 10, (10, 100))


def test_large_components_stay_exact(spark):
    rows = [(k, [x * 50_000 for x in v], label) for k, v, label in vectors(120)]
    assert got(N.mine(frame(spark, rows))) == plainly(rows)


def test_empty(spark):
    assert got(N.mine(frame(spark, vectors(4)).limit(0))) == []
    assert got(N.mine(frame(spark, [(1, [1.0], 1), (3, [1.0], 2)]))) == []  # no anchor


def test_tasks_send_few_buckets(spark):
    """A window's buckets leave a task only as far as its own k-th row."""
    rows = N.coded(frame(spark, vectors(2000)))
    shape = N.Shape.of(rows)
    turn = next(N.turns(rows, shape, 50))
    bound = np.full((1, len(turn.ids)), 1 << 20, np.int64)
    asked = N.Asked.new(True, -bound, bound, 5, shape)
    found = N.histograms(rows, shape, turn, asked).groupBy("window").count().collect()
    assert len(found) == len(turn.ids) and max(r["count"] for r in found) <= 5
