import random

import pytest

import corpus_pipeline
from corpusmill.llm import runs
from tests.llm.conftest import prose


def test_units():
    for text in ("", " ", "a b", "  aé\tb\n\nç ", "x" * 40, "日本語 text、です", "ab日c", "ไทย"):
        raw = text.encode()
        first, end = runs._units(raw)
        found = [raw[a:b].decode() for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        assert "".join(found) == "".join(text.split())
        assert len(runs._codes(raw)) == 4 * len(found)
    assert len(runs._units("日本語 text、です".encode())[0]) == 7


def brute(texts, n):
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i:i + n])] = seen.get(tuple(w[i:i + n]), 0) + 1
    out = []
    for t in texts:
        w = t.split()
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone.update(range(i, i + n))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("limit", [1, runs.INDEX_CONTEXTS])
def test_short_passages_of_over_fifty_words_go(spark, limit):
    rng = random.Random(5)
    short = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmn") for _ in range(n))
    fifty, one_more, long = short(50), short(51), short(80)
    texts = [prose(i, 60) for i in range(12)]
    for i in range(0, 12, 2):
        texts[i] += " x" + str(i) + " " + [fifty, one_more, long][i // 2 % 3] + "  y" + str(i) + " " + prose(100 + i, 20)
    texts.append(" ".join(["again"] * 130))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text.split() for r in runs.without_repeats(docs, words=51, index_contexts=limit).collect()}
    want = {i: w for i, w in enumerate(brute(texts, 51)) if w}
    assert len(one_more) < 400 and got == want


def test_stage_cuts_them(spark):
    passage = " ".join("ab cd ef gh ij kl mn op qr st".split()[(i * i + i // 7) % 10] for i in range(60))
    docs = spark.createDataFrame([(i, prose(i, 40) + " " + passage + " " + prose(20 + i, 40), 0) for i in range(3)], "doc_id bigint, text string, n_chars bigint")
    assert all("ab cd" not in r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect())
