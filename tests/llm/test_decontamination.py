import random

from corpusmill.llm import decontamination
from tests.llm.conftest import prose


def exchanged(words, at, seed):
    """The words with those at places ``at`` exchanged."""
    fresh = prose(90_000 + seed, len(words)).split()
    return [fresh[i] + "q" if i in at else w for i, w in enumerate(words)]


def hits(spark, items, texts):
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [h.item_id for h in r.hits] for r in decontamination.with_hits(docs, frame).collect()}



def test_answers_of_any_length(spark):
    items, texts, want = [], [], []
    for i, answer in enumerate(["paris.", "old town.", "", "three words here."]):
        question = prose(600 + i, 24).split()
        items.append((i, " ".join(question) + (". " + answer if answer else ".")))
        around = prose(700 + i, 120).split()
        gone = set(range(0, 20, 2))  # 10 of the first 20 words
        near = exchanged(question, gone, i) + answer.split()
        texts.append(" ".join(around[:60] + near + around[60:]))
        want.append([i])
        # the answer alone, away from the question or missing, does not decide
        far = exchanged(question, gone | {21, 23}, i) if not answer else exchanged(question, gone, i)
        texts.append(" ".join(around[:60] + (answer.split() if len(answer.split()) < 3 else []) + far + around[60:]))
        want.append([])
    got = hits(spark, items, texts)
    assert [got[i] for i in range(len(texts))] == want


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "nothing of it here", "own", "too")], "doc_id bigint, text string, `_hits_0` string, `_HITS_1` string")
    items = spark.createDataFrame([(5, "what is the tallest hill of the northern island called")], "item_id bigint, text string")
    got = decontamination.with_hits(docs, items, name="found")
    assert got.columns == [*docs.columns, "found"] and tuple(got.first()) == (1, "nothing of it here", "own", "too", [])


def test_space_is_fitted_on_everything(spark, monkeypatch):
    seen = []
    sketch = decontamination.sketch
    monkeypatch.setattr(decontamination, "sketch", lambda docs, weights: seen.append(sorted(r.text for r in docs.collect())) or sketch(docs, weights))
    monkeypatch.setattr(decontamination, "FIT_DOCS", 5, raising=False)
    texts = [prose(i, 30) for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts + texts[:1] * 60], "text string")
    decontamination.fitted(docs, spark.createDataFrame([("only in an item",), (None,)], "text string"))
    assert seen == [sorted([*texts, "only in an item"])]


def test_exchanged_rare_words_do_not_hide_an_item(spark):
    common = prose(1, 40).split()
    rng = random.Random(2)
    items, texts, want = [], [], []
    for i in range(6):
        words = [rng.choice(common) for _ in range(30)]
        rare = set(rng.sample(range(30), 9))
        words = exchanged(words, rare, 100 + i)
        items.append((i, " ".join(words) + "."))
        texts.append(" ".join(prose(300 + i, 60).split() + exchanged(words, rare, 200 + i) + prose(400 + i, 60).split()))
        want.append([i])
    fill = [" ".join(rng.sample(common, 30)) for _ in range(60)]
    got = hits(spark, items, texts + fill)
    assert [got[i] for i in range(len(texts))] == want
    assert not any(got[i] for i in range(len(texts), len(texts) + len(fill)))


def test_candidates_are_all_that_verification_takes():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    space = decontamination.gaussian()
    texts = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 2:
            own = items[i % 12][1].split()
            words[len(words) // 2:len(words) // 2] = [w for w in own if rng.random() < 0.75]
        texts.append(" ".join(words).encode())
    texts += [None, b"", b" ... "]
    whole = decontamination.Finder(items, space)
    want = []
    for t in texts:
        own, found = whole.words.hashes((t or b"").decode()).tolist(), set()
        size = decontamination.STRIDE
        for items_of, *_ in whole.groups.values():
            for item in items_of:
                for begin in range(0, max(1, len(own)), size):
                    window = own[begin:begin + (item.blocks + 2) * size]
                    share = item.share(window)
                    if share >= decontamination.COPY or share >= decontamination.PARAPHRASE and item.answered(window):
                        found.add(item.id)
        want.append(found)
    assert any(want)
    for cells in (1, 300, decontamination.CELLS):
        decontamination.CELLS, before = cells, decontamination.CELLS
        try:
            assert [{h[0] for h in f} for f in whole.find(texts)] == want
        finally:
            decontamination.CELLS = before


def test_words_are_those_of_a_plain_split():
    texts = ["", " ", "...", "A b!! «Ñé» ÑUO x—y q、 (it's) a", "　z Z z.\x1cz", "x" * 50 + " ¿qué? QUÉ", " ".join(prose(i, 40) for i in range(5)), "—", "end."]
    piece, decontamination.PIECE = decontamination.PIECE, 64
    try:
        small = [decontamination.word_hashes([t.encode() * 3])[0].tolist() for t in texts]
    finally:
        decontamination.PIECE = piece
    names = {}
    hashes, sizes = decontamination.word_hashes([*[t.encode() for t in texts], None])
    want = [[w for w in (c.strip(decontamination._ENDS).lower() for c in t.split()) if w] for t in texts]
    assert sizes.tolist() == [*map(len, want), 0]
    for word, number in zip([w for ws in want for w in ws], hashes.tolist(), strict=True):
        assert names.setdefault(word, number) == number
    assert len(set(names.values())) == len(names)
    assert [len(s) for s in small] == [len([w for w in (c.strip(decontamination._ENDS).lower() for c in (t * 3).split()) if w]) for t in texts]


def test_the_fitted_space_nominates(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"{w}{i % 7}" for w in prose(i, 30).split()) + ".") for i in range(40)]
    texts = []
    for i, text in items:
        words = text.split()
        around = [f"{w}{i % 7}" for w in prose(500 + i, 160).split()]
        texts.append(" ".join(around[:80] + exchanged(words, set(rng.sample(range(30), 6)), i) + around[80:]))
    docs, frame = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(items, "item_id bigint, text string")
    space = decontamination.fitted(docs, frame.select("text"))
    finder = decontamination.Finder(items, space)
    given = [t.encode() for t in texts]
    exact = {(i, h[0]) for i, hits in enumerate(finder.find(given)) for h in hits}
    got = {(i, h[0]) for i, hits in enumerate(finder.search(given)) for h in hits}
    assert len(exact) >= 36 and got <= exact and len(got) >= 0.9 * len(exact)
    # rows of no meaning find less, so it is the space that nominates
    nothing = decontamination.np.tile(decontamination.np.array([1.0, -1.0], "f4"), (len(space), 1)) * decontamination.np.random.default_rng(1).choice([-1, 1], (len(space), 1))
    blind = decontamination.Finder(items, nothing.astype("f4"))
    blind.placed[:] = True
    blind_items = {i.id for own, *_ in blind.by_cosine.values() for i in own}
    assert blind_items == set(range(40))
    assert len({(i, h[0]) for i, hits in enumerate(blind.search(given)) for h in hits}) < 0.9 * len(exact)


def test_long_texts_are_folded_in_slices(spark, monkeypatch):
    items = [(i, prose(900 + i, 30) + ".") for i in range(6)]
    texts = [" ".join([prose(40, 4000), items[3][1], prose(41, 3000), items[5][1]]), None, "", "short one", items[0][1]]
    docs, frame = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(items, "item_id bigint, text string")
    given = [None if t is None else t.encode() for t in texts]
    space = decontamination.fitted(docs, frame.select("text"))
    want = [sorted(h[0] for h in hits) for hits in decontamination.Finder(items, space).search(given)]
    assert want == [[3, 5], [], [], [], [0]]
    monkeypatch.setattr(decontamination, "ROWS", 7)
    assert [sorted(h[0] for h in hits) for hits in decontamination.Finder(items, space).search(given)] == want
    g = decontamination.sketch(docs, decontamination.np.ones(decontamination.BUCKETS))
    monkeypatch.setattr(decontamination, "ROWS", 16384)
    assert decontamination.np.allclose(g, decontamination.sketch(docs, decontamination.np.ones(decontamination.BUCKETS)), atol=1e-3)
