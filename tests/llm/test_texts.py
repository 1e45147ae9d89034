"""Tokens, chat strings and license scans."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import bpe, chat, common, licenses
from corpusmill.session import read_table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def wanted(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.merger.ranks, special_tokens={}).encode_ordinary


def ids(codec, text):
    return np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist()


def test_tokens_of_documents(spark, codec, wanted):
    for r in read_table(spark, SMALL, "documents").collect():
        assert ids(codec, r.text or "") == wanted(r.text or "")


def test_tokens_of_random_texts(codec, wanted):
    rng = random.Random(3)
    parts = [" ", " ", "\n", "\t", "a", "b", "'s", "'", ".", "1", "é", "\x1c", "　", "\r", "'ll", "word", "<|endoftext|>", " ", "\U0001f600", "中"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert ids(codec, text) == wanted(text)
        assert codec.decode(codec.encode([text.encode()])[0]) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 3000, "q" * 5001, " " * 4000, "\n \n" * 500, "x y" * 2000 + "  z", "7" * 999, "é" * 1500])
def test_tokens_of_long_pieces(codec, wanted, text):
    assert ids(codec, text) == wanted(text)


def test_tokens_of_odd_rows(odd, none):
    rows = bpe.encode_digests(odd, PATH, PATTERN, with_ids=True).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id == 2} == {0}
    back = bpe.decode(bpe.encode(odd, PATH, PATTERN, name="tokens"), PATH, PATTERN, ids="tokens").collect()
    assert all((r.text or "").encode() == bytes(r.decoded) for r in back)
    assert bpe.encode_digests(none, PATH, PATTERN).count() == 0


TURNS = [
    (1, 0, "user", "a"), (1, 1, "user", "b~2"), (1, 2, "assistant", "</s>[INST] ok [/INST] ~0 <s>"), (1, 2, "assistant", "</s>[INST] ok [/INST] ~0 <s>"),
    (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "[/INST"), (None, 5, "sys[INST]tem", "x\n"), (None, 5, "sys[INST]tem", None),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "other", "x") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, formatted string, turns string")
    made = chat.format_conversations(turns)
    rows = {r.conv_id: (r.formatted, [(t.role, t.text) for t in r.turns]) for r in made.select("conv_id", "formatted", chat.read_turns(made.formatted).alias("turns")).collect()}
    for conv in (1, 2, None):
        order = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        assert rows[conv][1] == [(t[2] or "", t[3] or "") for t in order]
    assert rows[1][0].count("<s>") == 2 and rows[1][0].startswith("<s>user[INST]a[/INST]b~02</s><s>assistant[INST]")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_license_blocks(spark, odd, none):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "x\nReleased   under the MIT license!\ny", "released under mit", None, "", "cc BY-nc cc by nc",
        "the license this work is licensed under: GNU General Public License version 3", "THIS WORK\nis licensed under the GNU General\nPublic License version 3", "KIT license under the mit",
        "a\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted\nb",
        "# This Source Code Form is subject to\n# the terms of the Mozilla Public\n# License, v. 2.0.",
    ]
    docs, blocks = licenses.license_scan(spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, places int, words string"))
    found = {r.doc_id: sorted((p.start, p.label) for p in r.places) for r in docs.collect()}
    assert found[0] == [(3, "apache-2")] and found[1] == [(2, "mit")] and found[5] == [(0, "cc-by-nc"), (3, "cc-by-nc")] and not found[3] and not found[8]
    want = set()
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for line in (" ".join(lines[j:j + licenses.BLOCK_LINES]) for j in range(len(lines))):
            held = set("".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in line).split())
            want |= {(i, k) for k, (template, _) in enumerate(licenses.TEMPLATES) if len(held & set(template.split())) >= licenses.THRESHOLD * len(set(template.split()))}
    assert {(r.doc_id, r.template) for r in blocks.collect()} == want and {(6, 3), (7, 3), (9, 4), (10, 6)} <= want
    docs, blocks = licenses.license_scan(odd)
    assert docs.count() == odd.count() and {r.doc_id for r in blocks.collect()} == {10}
    docs, blocks = licenses.license_scan(none)
    assert docs.count() == blocks.count() == 0


def test_an_operator_that_keeps_nothing_releases_what_the_one_before_it_kept(spark, monkeypatch):
    docs = spark.range(1).select(F.lit("a").alias("text"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)

    def of(module, maker):
        maker.__module__ = module
        return common.annotate(docs, "text", [("kept", T.LongType())], maker)

    def keeps():
        def make():
            return "table"

        make.__module__ = "first"
        return lambda texts: [[len(common.once("table", make)) for _ in texts]]

    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    assert [b.column(1).to_pylist() for b in of("first", keeps)([batch])] == [[5]] and common._MADE
    assert [b.column(1).to_pylist() for b in of("first", lambda: lambda texts: [[len(common._MADE)]])([batch])] == [[1]]
    assert [b.column(1).to_pylist() for b in of("second", lambda: lambda texts: [[len(common._MADE)]])([batch])] == [[0]]


def test_a_worker_at_rest_remembers_little(spark, monkeypatch):
    docs = spark.range(1).select(F.lit("a").alias("text"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    words = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(300)]
    run = bpe.encode(docs, PATH, PATTERN)
    before = [b.column(1).to_pylist() for b in run([pa.RecordBatch.from_pydict({"text": words}), pa.RecordBatch.from_pydict({"text": ["w0x0 w0x1 end"]})])]
    held = next(v for k, v in common._MADE.items() if k[0] == "bpe")
    assert set(held.runs) == {"w0x1", "end"} and held.held < 1000 and sum(map(len, (held.runs, held.pieces))) <= 4
    again = [b.column(1).to_pylist() for b in run([pa.RecordBatch.from_pydict({"text": words[:3]})])]
    assert again[0] == before[0][:3]


def test_encoding_with_little_memory_gives_the_same_ids(codec, monkeypatch):
    texts = [" ".join(f"w{i}x{j % 7} and  so,on" for j in range(50)).encode() for i in range(40)] + [None, b"", b" a"]
    wanted = codec.encode(texts)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)
    small = bpe.Codec(PATH, PATTERN)
    made, most = [], 0
    for t in texts:
        made += small.encode([t])
        most = max(most, len(small.runs))
    assert made == wanted and most < 300
