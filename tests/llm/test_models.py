"""Trained models: gradients, held-out accuracy, odd rows; decontamination by planted items."""

import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import common, decontamination, languages, quality, toxicity

from .conftest import prose


def check_gradients(weights, loss, grads, names=None):
    rng = np.random.default_rng(0)
    for k in names or weights:
        at = tuple(rng.integers(0, s) for s in weights[k].shape)
        old = weights[k][at]
        weights[k][at] = old + 1e-4
        up = loss()
        weights[k][at] = old - 1e-4
        down = loss()
        weights[k][at] = old
        assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-3, k


def test_quality_gradients():
    rng = np.random.default_rng(0)
    shapes = {"w": (quality.FEATURES, quality.ENCODED), "b": (quality.ENCODED,), "v": (quality.ENCODED, quality.ATTENTION), "u": (quality.ENCODED, quality.ATTENTION),
              "a": (quality.ATTENTION,), "c": (quality.ENCODED,), "d": (1,)}
    w = {k: rng.standard_normal(s) * 0.1 for k, s in shapes.items()}
    x, bag, y = rng.standard_normal((7, quality.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([0, 1, 1.0])

    def loss():
        p = quality.sigmoid(quality._attend(w, x, bag, 3)[-1] @ w["c"] + w["d"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    check_gradients(w, loss, quality._gradients(w, x, bag, y))


def test_language_gradients():
    network = languages.Network.fresh(3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    data, used = languages.padded([b"abc", b"de", b"fghij"], 5)
    y = np.array([0, 1, 2])
    grads = network.gradients(data, used, y)[1]
    check_gradients(network.w, lambda: network.gradients(data, used, y)[0], grads, [k for k in network.w if k != "e"])
    i = (ord("d"), 2)
    old = network.w["e"][i]
    network.w["e"][i] = old + 1e-2
    up = network.gradients(data, used, y)[0]
    network.w["e"][i] = old - 1e-2
    assert abs((up - network.gradients(data, used, y)[0]) / 2e-2 - grads["e"][i]) < 1e-3


def test_quality_learns(spark, odd, none):
    rows = [(prose(i, 100 + i % 90).encode(), 1) for i in range(150)] + [(" ".join(w + "%%" for w in prose(i, 80).upper().split()).encode(), 0) for i in range(150, 250)]
    random.Random(0).shuffle(rows)
    model = quality.train(rows[:180])
    scores = quality.score(model, [t for t, _ in rows[180:]])
    assert np.mean([(s >= 0.7) == y for s, (_, y) in zip(scores, rows[180:], strict=True)]) > 0.95
    got = quality.with_score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.with_score(none, model).count() == 0
    assert quality.score(quality.train([]), [b"x", None]) == [0.5, 0.5] and quality.score(quality.train([(b"x", 1)]), [None]) == [1.0]


def test_language_learns(spark, odd, none):
    def text(kind, seed):
        rng = random.Random(seed)
        parts = [["the", "and", "ing", "tion"], ["der", "und", "sch", "ß"], ["ção", "que", "lh", "os"]][kind]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)).encode()

    rows = [(text(i % 3, i), "abc"[i % 3]) for i in range(90)]
    model = languages.train(rows[:60], steps=150)
    reader = languages.Reader(model)
    names, scores = reader.predict([t for t, _ in rows[60:]] + [None, b"", b"12 ... 3"])
    assert np.mean([a == y for a, (_, y) in zip(names, rows[60:], strict=False)]) > 0.95
    assert names[-3:] == ["und"] * 3 and scores[-3:] == [0.0] * 3
    got = languages.with_language(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert languages.with_language(none, model).count() == 0 and languages.train([]) is None
    assert {r.lang_pred for r in languages.with_language(odd, None).collect()} == {"und"}


def test_letters_only():
    assert not any(map(languages.has_letter, ["", "½ ² Ⅷ ① 12 _ ٣"])) and all(map(languages.has_letter, ["1a", "ß", "ª", "ʰ", "中"]))


def test_grammar():
    outputs = toxicity.Grammar(("zorb",)).outputs
    names = lambda text: [n for n, c in zip(toxicity.OUTPUTS, outputs(text), strict=True) for _ in range(int(c))]
    assert names("What a stupid thing.") == ["plain"]
    assert names("You are stupid. He left.") == ["aimed"]
    assert names("You are not stupid.") == ["negated"]
    assert names("Not now. You are stupid!") == ["aimed"]
    assert names("She wrote that you are stupid.") == ["reported"]
    assert names("I will kill you. They kill time") == ["threat"] and names("to kill time") == []
    assert names("we should burn them all alive") == names("Ich werde dich töten") == ["threat"] and names("I will not kill you.") == ["negated"]
    assert names("kill the process you started") == names("Will you kill the process?") == [] and names("eres un imbécil") == ["aimed"]
    assert names("a Zorblan came; idiotic") == ["stem"]
    assert names("") == [] and names("...") == []


def through_each(symbols):
    """All paths of a clause, by listing what each transducer writes and giving it to the next one."""
    lines = [(list(symbols), [])]
    for part in toxicity.cascade():
        lines = [(out, took + more) for line, took in lines for out, more in part.paths(line)]
    return [tuple(took) for _, took in lines]


def test_composed_machine_is_the_cascade():
    rng = random.Random(4)
    grammar = toxicity.Grammar()
    for n in [*range(7)] * 300:
        symbols = [rng.choice(toxicity.READ) for _ in range(n)]
        assert through_each(symbols) == [grammar.walk(symbols)], symbols
    for x in toxicity.READ:  # every clause of up to three symbols that begins with x
        for y in toxicity.READ:
            for z in toxicity.READ:
                assert through_each([x, y, z]) == [grammar.walk([x, y, z])]


def test_arc_weights_are_learned():
    pieces = {"threat": "I will kill you.", "negated": "You are not stupid.", "reported": "She wrote that you are stupid.", "aimed": "You are stupid."}
    rows = [(f"{prose(i, 20)} {text}".encode(), int(name in ("threat", "aimed"))) for i in range(80) for name, text in pieces.items()]
    weights = dict(zip(toxicity.OUTPUTS, toxicity.train(rows).weights, strict=False))
    assert weights["threat"] > 0 > max(weights["negated"], weights["reported"]) and weights["aimed"] > 0
    turned = dict(zip(toxicity.OUTPUTS, toxicity.train([(t, 1 - y) for t, y in rows]).weights, strict=False))
    assert turned["negated"] > weights["negated"] and turned["threat"] < weights["threat"]
    some = toxicity.train([r for r in rows if b"kill" not in r[0]])
    assert some.score("We should burn them all alive") > 0.7 > some.score("Kill the process you started") and some.weights[toxicity.OUTPUTS.index("threat")] > 1


def test_toxicity_learns_beginnings(spark, odd, none):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(i, 60).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randint(0, 60), rng.choice(["idiot", "zorkaba", "zorklu"]) if i % 8 else rng.choice(["zorkim", "zorkost"]))
        rows.append((" ".join(words).encode(), int(i % 4 == 0)))
    grammar = toxicity.train(rows[:300])
    assert any("zork".startswith(s) or s.startswith("zork") for s in grammar.stems)
    assert all((grammar.score(t.decode()) >= 0.7) == bool(y) for t, y in rows[300:])
    got = toxicity.with_score(odd, grammar).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.score >= 0.7} == {11}
    assert toxicity.with_score(none, grammar).count() == 0
    assert toxicity.Grammar().score("You idiot. You moron.") > 0.7 > toxicity.train([]).score("fine")


def test_labelled_sample(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (1, 1), (99, 1), (8, None)], "doc_id bigint, toxic int")
    got = common.labelled_sample(odd.select("doc_id", "text"), labels, "toxic", 10)
    assert len(got) == 2 and sorted(y for _, y in got) == [0, 1]
    assert common.labelled_sample(none.select("doc_id", "text"), labels, "toxic", 10) == []


def test_remainder(spark, odd):
    got = odd.where("doc_id is not null").select("doc_id", common.remainder(odd.doc_id, 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [[rng.randint(0, 4) for _ in range(rng.randint(0, 20))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_decontamination(spark, odd, none):
    rng = random.Random(5)
    items = [(i, prose(1000 + i, 20 + i) + ". " + prose(2000 + i, 5) + ".") for i in range(8)] + [(50, None), (51, ""), (None, prose(77, 30))]
    texts, want = [], []
    for i in range(40):
        words = prose(3000 + i, 150).split()
        if i % 2:
            item = items[i % 8][1].split()
            if i % 4 == 1:  # a tenth of the words exchanged, other case
                item = [rng.choice(words) if rng.random() < 0.1 else w.upper() for w in item]
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append(" ".join(words))
        want.append([i % 8] if i % 2 else [])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, share string")
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontamination.with_hits(docs, frame).collect()}
    assert [got[i] for i in range(40)] == want
    assert decontamination.with_hits(none, frame).count() == 0
    clean = decontamination.with_hits(odd, frame.limit(0)).collect()
    assert len(clean) == odd.count() and not any(r.hits for r in clean)


def test_blocks_of_items(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "word " * i) for i in range(7)], "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 3)
    assert [len(b) for b in decontamination.item_blocks(frame)] == [3, 3, 1]
    docs = spark.createDataFrame([(1, prose(5, 80))], "doc_id bigint, text string")
    more = spark.createDataFrame([(i, prose(5, 80) if i == 5 else prose(i + 100, 30)) for i in range(7)], "item_id bigint, text string")
    assert [[h.item_id for h in r.hits] for r in decontamination.with_hits(docs, more).collect()] == [[5]]


@pytest.mark.parametrize("stage", range(5))
def test_stage_with_odd_rows(spark, odd, none, tmp_path, stage):
    import corpus_pipeline

    directory = str(tmp_path)
    spark.createDataFrame([(4, 1), (11, 1), (7, 0)], "doc_id bigint, toxic int").write.parquet(f"{directory}/labels.parquet")
    spark.createDataFrame([(0, prose(900, 30)), (None, None)], "item_id bigint, text string").write.parquet(f"{directory}/benchmark.parquet")
    for docs in (odd, none):
        made = corpus_pipeline.STAGES[stage][1](spark, docs, directory)
        rows = made.collect()
        assert bool(rows) == (docs is odd)
        if stage < 4:
            assert made.columns == docs.columns
