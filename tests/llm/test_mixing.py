import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing


def by_hand(sizes):
    """Targets by resharing the excess round by round; ``sizes`` maps a source (None last) to its words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return target


def taken(spark, docs):
    return [r.asDict() for r in mixing.mixed(docs).collect()]


def check(rows, texts):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in rows) == sorted((str(i), str(s), size(t)) for i, s, t in texts)
    sizes = {}
    for _, s, t in texts:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = by_hand(sizes)
    for s, words in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == words and r["target"] == pytest.approx(target[s]) for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1
    return target


def test_against_targets_by_hand(spark):
    rng = np.random.default_rng(4)
    texts = [(i, ["b", "a", "é", "z", None, ""][int(rng.integers(0, 6)) if i > 200 else 0], " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    rows = taken(spark, docs)
    check(rows, texts)
    again = taken(spark, docs.repartition(7))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_odd_rows(spark, odd, odd_rows, none):
    texts = [(r[0], r[3], r[1]) for r in odd_rows]
    check(taken(spark, odd), texts)
    assert taken(spark, none) == []
    hot = [(i, "hot", "one two three") for i in range(3000)] + [(7, "hot", "one two three")] * 500 + [(5, "cold", "a b"), (None, None, None)]
    check(taken(spark, spark.createDataFrame(hot, "doc_id long, source string, text string")), hot)
    blank = [(1, "a", ""), (2, None, None)]
    assert all(r["target"] == 0 and r["taken"] == 0 for r in taken(spark, spark.createDataFrame(blank, "doc_id long, source string, text string")))


@pytest.mark.parametrize("seed", range(8))
def test_nearest_sum_is_nearest(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 4, replace=False))
    counts = rng.integers(0, 4, 4)
    budget = float(rng.uniform(0, (lengths * counts).sum()))
    got = mixing.nearest_sum(lengths, counts, budget)
    assert (got >= 0).all() and (got <= counts).all()
    best = min(abs(float(np.dot(lengths, c)) - budget) for c in itertools.product(*[range(n + 1) for n in counts]))
    assert abs(float((lengths * got).sum()) - budget) == pytest.approx(best)


def test_large_budget_is_met():
    rng = np.random.default_rng(9)
    lengths = np.sort(rng.choice(np.arange(1, 20_000), 3000, replace=False))[::-1]
    counts = rng.integers(1, 50, 3000)
    budget = 0.37 * float((lengths * counts).sum())
    got = mixing.fill(lengths, counts, budget)
    assert (got <= counts).all() and abs(float((lengths * got).sum()) - budget) <= 0.5
    part = (lengths * got).reshape(10, -1).sum(axis=1) / (lengths * counts).reshape(10, -1).sum(axis=1)
    assert part[:-1].min() > 0.3 and part[:-1].max() < 0.45  # every range of lengths gives its share


def test_given_documents(spark):
    rows = mixing.op11(spark, "/root/testdata/sf0.001")
    sums = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert rows.count() == 200 and all(abs(r["t"] - r["g"]) <= r["m"] / 2 + 1 for r in sums)
