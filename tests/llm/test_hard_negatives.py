"""Hard-negative mining against scores of all pairs."""

import random

import numpy as np
import pytest

from pagelens.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, d string"


def rows():
    rnd = random.Random(11)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    out = []
    for i in range(700):
        c = rnd.choice(centres)
        out.append((i, [x + rnd.gauss(0, 0.2) for x in c], rnd.randrange(4), i, "x"))
    out += [(1000 + i, centres[0], i % 3, 0, "t") for i in range(60)]  # ties
    out += [(2000, [0.0] * 6, 1, 0, ""), (2001, [0.0] * 6, 2, 0, ""), (2002, [1.0, 2.0], 1, 0, ""), (2003, [1.0, 2.0], 1, 0, ""), (2004, [1.0, 2.0], 2, 0, "")]
    out += [(3000, None, 1, 0, ""), (3001, [1.0, None], 1, 0, ""), (3002, [float("nan")] * 6, 1, 0, ""), (3003, [float("inf")] * 6, 1, 0, ""), (3004, [1.0] * 6, None, 0, ""), (None, [1.0] * 6, 1, 0, ""), (3005, [], 1, 0, "")]
    return out + [out[20], out[21], (20, centres[1], 3, 0, "")]


def brute(all_rows, every, k=5):
    used = [(i, y, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, y, *_ in all_rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, y, v in used:
        if i % every == 0:
            asked[i] = min(asked.get(i, (y, v)), (y, v))
    out = []
    for a, (label, q) in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, y == label) for i, y, v in used if i != a and len(v) == len(q))
        for s, p in [(-s, i) for s, i, same in scored if same][:k]:
            fits = [(-t, i) for t, i, same in scored if not same and 80 * s <= -100 * t <= 100 * s][:k]
            out += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,pivots", [(64, 4), (1 << 13, 16), (200, 0)])
def test_mined(spark, shard_rows, pivots):
    table = hn.quantised(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    got = hn.mined(table, table.where("vec_id % 10 = 0"), shard_rows=shard_rows, pivots=pivots)
    assert sorted(map(tuple, got.collect())) == brute(rows(), 10)


def test_empty(spark):
    none = hn.quantised(spark.createDataFrame([], SCHEMA))
    assert hn.mined(none, none).count() == 0
    one = hn.quantised(spark.createDataFrame([(0, [1.0], 1, 0, "")], SCHEMA))
    assert hn.mined(one, one).count() == 0


def test_brackets_hold_and_prune():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 8)) * 300
    x = np.floor(centres[rnd.integers(0, 20, 4000)] + rnd.normal(size=(4000, 8)) * 10)
    space = hn.Space(int((x**2).sum(1).max()), x[:500].astype(int).tolist(), 16)
    shard = hn.Shard(np.arange(4000), np.zeros(4000, int), x, space.distances(x, space.added(x)), space)
    for q in x[:50]:
        low, high = shard.bracket(q, np.arange(4000))
        assert (low <= x @ q).all() and (x @ q <= high).all()
        ((at, score),) = shard.best(q, np.arange(4000), np.array([[-np.inf, np.inf]]), 5)
        assert score.tolist() == sorted((x @ q).tolist(), reverse=True)[:5]
    assert shard.tested < 50 * 4000 / 4  # most rows are ruled out by their brackets
