"""SimHash groups, near vectors and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from corpusmill.llm import cap_filters, near_copies, runs, simhash
from corpusmill.llm.common import components
from corpusmill.session import read_table

from .conftest import prose


def closure(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[root(a)] = root(b)
    return [root(i) for i in range(n)]


def smallest(ids, roots):
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in roots]


def plain_fingerprint(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", small)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("source", ["small", "odd"])
def test_simhash(spark, odd, source):
    docs = read_table(spark, SMALL, "documents") if source == "small" else odd
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    roots = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    want = sorted(zip([r.doc_id for r in rows], prints, smallest([r.doc_id for r in rows], roots), strict=True), key=str)
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got, key=str) == want


def test_simhash_finds_all_within_four_bits(spark):
    rng = random.Random(4)
    prints = {0, 1 << 63}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for flips in (1, 2, 3, 4, 5):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4}


def test_first_of_groups(spark, odd, none):
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 7 in ids and -5 in ids
    assert simhash.first_of_groups(none).count() == 0


def test_first_of_groups_keeps_columns_of_any_name(spark):
    names = ["_id", "_text_key", "_Key", "_component", "_first_id", "_first_key", "text_key", "a.b"]
    rows = [(1, "a b c d e f", *map(str, range(8))), (2, "a b c d e f", *"xxxxxxxx"), (None, "g", *"yyyyyyyy"), (None, "g", *"yyyyyyyy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    for first in (simhash.first_of_groups, near_copies.first_of_groups):
        got = first(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[::2], key=str)


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    extra = [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(40)]
    links = chain + extra
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint").repartition(7)).collect()}
    nodes = sorted({x for e in links if e[0] != e[1] for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    roots = closure(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    assert got == dict(zip(nodes, smallest(nodes, roots), strict=True))


def brute_vectors(ids, vectors):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    roots = closure(len(ids), zip(*np.nonzero(links), strict=True))
    return sorted(zip(ids, links.sum(1).tolist(), smallest(ids, roots), strict=True))


@pytest.mark.parametrize("cell", [3, 2048])
def test_near_vectors(spark, cell):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    vectors = [base[i % 40] + rng.standard_normal(32) * 0.12 * (i // 40) for i in range(160)] + [base[0], base[0] * 2]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_vectors(frame, cell=cell).collect())
    want = brute_vectors(list(range(len(vectors))), vectors)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 8


def test_recall_near_the_limit():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9 * a + np.sqrt(1 - 0.81) * b
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(cap_filters.decode(a), cap_filters.decode(near), strict=True)]
    assert np.mean(shared) > 0.98


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (None, [1.0, 1.0]), (9, [1.0]), (10, [1e300, 1e300]), (7, [1.0, 1.0])]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(
        [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9)] + [(7, 4, 7), (7, 4, 7), (8, 4, 7), (None, 4, 7), (10, 4, 7)], key=str)
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def brute_spans(texts, width):
    seen = collections.Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_index_of_runs():
    rng = random.Random(1)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abcd", bytes(range(65, 91))])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randint(5, 40))) for _ in range(4)]
        texts = list({b"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))})
        width = rng.choice([3, 8, 15])
        seen = collections.Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
        assert [x.tolist() for x in runs.repeated_starts(texts, width)] == [[i for i in range(len(t) - width + 1) if seen[t[i:i + width]] > 1] for t in texts]


@pytest.mark.parametrize("limit", [1, runs.INDEX_CONTEXTS])
def test_repeated_passages(spark, limit):
    passage, wide = prose(50, 40), "ab" * 300
    texts = [prose(i, 60) for i in range(20)]
    for i in range(0, 20, 2):
        texts[i] += passage + texts[i + 1][:70]
    texts += [passage, wide, "x" + wide + "y", None, "", texts[3], texts[3], "é" * 400]
    docs = runs.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = runs.with_spans(docs, 100, gram=20, index_contexts=limit).collect()
    got = {}
    for r in rows:
        text = (r.text or "").encode()
        kept, gone = runs.cut(text, [(s.start, s.stop) for s in r.spans or []])
        got[r.doc_id] = (len(text), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest())
    assert [got[i] for i in range(len(texts))] == brute_spans([(t or "").encode() for t in texts], 100)


def test_without_repeats(spark, odd, none):
    left = runs.without_repeats(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert 5 not in ids and 7 in ids and 2 in ids and 1 in ids
    assert runs.without_repeats(none).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    text = prose(9, 3000).encode()
    whole = runs.anchored([text], 100, 20)
    monkeypatch.setattr(runs, "_POSITION_BITS", 12)
    parts = runs.anchored([text], 100, 20)
    covered = lambda found: sorted({s for a, b in zip(found[2].tolist(), found[3].tolist(), strict=True) for s in range(a, b + 1)})
    assert covered(whole) == covered(parts) == list(range(len(text) - 99))
