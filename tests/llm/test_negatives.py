import itertools
import math
import random

import numpy as np
import pytest

from corpusmill.llm import negatives


def brute(rows):
    """Rows (vec_id, vector, label) to the set of answers, by every pair."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, m, w) in enumerate(kept) if b != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def made(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", "y", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, row string, score string, grp int")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).collect())


def drawn(seed, n, dim=6, spread=1.0):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(heads)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_all_pairs(spark, monkeypatch, spread):
    rows = drawn(1, 700, spread=spread)
    assert made(spark, rows) == brute(rows)
    monkeypatch.setattr(negatives, "SEGMENT", 90)  # many segments, groups and centres
    monkeypatch.setattr(negatives, "GROUP", 2)
    assert made(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = drawn(2, 120, dim=3)
    rows += [(200, None, 1), (300, [1.0, None, 2.0], 1), (400, [1.0, math.inf, 0.0], 1), (500, [math.nan] * 3, 2), (600, [0.1, 0.2, 0.3], None), (None, [1.0, 1.0, 1.0], 1),
             (700, [0.0, 0.0, 0.0], 1), (701, [0.0, 0.0, 0.0], 1), (702, [0.0, 0.0, 0.0], 2), (800, [], 1), (900, [1.0, 2.0], 1), (901, [1.5, 2.0], 1), (902, [0.7, 1.0], 2),
             (1000, [9.0, 9.0, 9.0], 1), (1000, [9.0, 9.0, 9.0], 1), (1001, [70000.0, 0.0, 0.0], 1), (-100, [-1.0, -1.0, 0.5], 1)]
    rows += [(10_000 + i, [4.0, 4.0, 4.0], 3) for i in range(40)]  # ties go by id
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == [] and made(spark, [(1, [1.0], 1)]) == []


def test_walk_ends_at_its_certificate():
    rng = np.random.default_rng(3)
    heads = negatives._unit(rng.standard_normal((20, 16)))
    rows = np.floor(256 * (heads[rng.integers(0, 20, 20_000)] + 0.02 * rng.standard_normal((20_000, 16))))
    members = np.floor(256 * (heads[0] + 0.02 * rng.standard_normal((8, 16))))
    best = negatives._Best(5, 8, np.full(8, negatives.LEAST))

    def offer(alive, at, scores):
        m, x = np.nonzero(scores >= best.worst[alive][:, None])
        best.add(alive[m], scores[m, x], at[x], at[x])

    met = negatives.walk(members, lambda: best.worst, rows, heads[0], offer)
    assert met < 0.3 * members.shape[0] * len(rows)
    exact = np.sort((members @ rows.T).astype(np.int64), axis=1)[:, ::-1][:, :5]
    got = [sorted((int(s) for s, m in zip(best.held[1], best.held[0]) if m == i), reverse=True) for i in range(8)]
    assert got == exact.tolist()
    assert all(len(list(g)) == 5 for _, g in itertools.groupby(best.held[0]))
