"""Cases in which rows, files or values went missing or wrong before."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.functions import generators
from corpusmill.functions.draws import Draws
from corpusmill.functions.responses import parse_fields
from corpusmill.functions.text import with_html_text
from corpusmill.operators import chunking, context
from corpusmill.operators.elements import parse_pages
from corpusmill.plans.catalog import QUERIES
from corpusmill.plans.answers import retrieve
from corpusmill.plans.ingest import ingest_documents
from corpusmill.sources.files import direct_text, parse_files
from corpusmill.sources.knowledge_base import KnowledgeBase

DOCS = "doc_key string, filename string, source string, text string, success boolean, error string"

HARD_PAGES = [
    ("<p>A</p><script>if(a<!b){x()}</script><p>B</p>", "A\nB"),
    ("<p>A</p><script>var s='<!--'</script><p>B</p>", "A\nB"),
    ("<!-- <script> --><p>A</p><!-- </script> -->B", "A\nB"),
    ("<a title=it's>link</a> end", "link\nend"),
    ("<a title='a > b' x=\"<p>\">link</a>", "link"),
    ("A<!-- unclosed <p>B", "A"),
    ("A<style>p > a {}</style>B<!DOCTYPE x>C<?php x ?>D", "A\nB\nC\nD"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
]


def test_page_text(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HARD_PAGES)], "page_id int, html string")
    got = {r.page_id: r.text for r in with_html_text(frame, "html", "text").collect()}
    assert [got[i] for i in range(len(HARD_PAGES))] == [t for _, t in HARD_PAGES]


def test_any_chunk_size(spark):
    docs = spark.createDataFrame([("abcdefghij",)], "text string")
    assert docs.select(chunking.fixed_chunks(F.col("text"), 4, 1)).first()[0] == ["abcd", "defg", "ghij"]
    chunking.check_settings(5000, 1000)


def test_sources_of_queries_without_hits(spark):
    hits = spark.createDataFrame([(1, "a.txt", None)], "query_id int, filename string, source string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.sources for r in context.relevant_sources(hits, queries=queries).collect()}
    assert got == {1: ["a.txt"], 2: []}


def test_lone_surrogates_fail_their_row_only(spark):
    rows = [("a.json", b'{"a":"\\ud800"}'), ("b.json", b'{"a":1}')]
    got = {r.path: (r.success, r.text) for r in parse_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.json"] == (False, "") and got["b.json"] == (True, '{\n  "a": 1\n}')
    own = {"pdf": lambda raw: "\ud800" if raw == b"x" else "fine"}
    got = {r.path: r.success for r in parse_files(spark.createDataFrame([("a.pdf", b"x"), ("b.pdf", b"y")], "path string, content binary"), own).collect()}
    assert got == {"a.pdf": False, "b.pdf": True}


@pytest.mark.parametrize("kind,low,high", [("age", {"min": 150.0}, {"max": 5.0}), ("number", {"min": 5000.0}, {"max": -3.0}), ("price", {"min": 2000.0}, {"max": 0.001})])
def test_one_sided_bounds(spark, kind, low, high):
    draw = {"age": generators.valid_age, "number": generators.valid_number, "price": generators.valid_price}[kind]
    rows = spark.range(200).select(F.col("id"), Draws(1, F.col("id"), F.lit("f")).between(0, 0, 1).alias("x"))

    def values(constraints):
        pairs = [F.lit(x) for item in constraints.items() for x in item]
        return [r[0] for r in rows.select(draw(Draws(1, F.col("id"), F.lit("f")), F.create_map(*pairs))).collect()]

    assert all(v >= low["min"] for v in values(low))
    assert all(v <= high["max"] for v in values(high))
    assert set(values({"min": 9.0, "max": 2.0})) == {None}


def test_text_within_its_length(spark):
    d = Draws(1, F.col("id"), F.lit("f"))
    got = spark.range(100).select(generators.valid_text(d, F.create_map(F.lit("max_length"), F.lit(5.0)))).collect()
    assert all(len(r[0]) <= 5 for r in got)


def test_mixed_constraints(spark):
    text = '[{"field_name":"a","data_type":"text","required":true,"constraints":{"format":"email","max_length":50,"min":"18"}}]'
    fields = spark.createDataFrame([(text,)], "t string").select(parse_fields(F.col("t"))).first()[0]
    assert fields[0]["constraints"] == {"max_length": 50.0, "min": 18.0}


def documents(spark, **texts):
    return spark.createDataFrame([(k, f"{k}.txt", None, t, True, None) for k, t in texts.items()], DOCS)


def ask(kb, encoder, spark, text, k=5):
    queries = encoder.encode(spark.createDataFrame([(1, text)], "query_id int, text string"))
    return retrieve(queries, kb.load(), k).orderBy("rank").collect()


def test_ingest_again(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    first = ingest_documents(documents(spark, a="apples and pears grow here", b="the sea is blue today"), kb)
    assert first.summary.first().total_chunks == 2
    assert ingest_documents(documents(spark, a="apples and pears grow here"), kb).summary.first().total_chunks == 0
    last = ingest_documents(documents(spark, a="only plums grow here now", c="a third text about cars"), kb)
    assert last.summary.first().total_chunks == 2
    assert {r.text for r in kb.load().collect()} == {"only plums grow here now", "the sea is blue today", "a third text about cars"}
    for text in ("the sea is blue today", "a third text about cars"):  # one vector space for all of them
        hit = ask(kb, last.encoder, spark, text)[0]
        assert hit.text == text and hit.distance < 1e-6
    assert len(ask(kb, last.encoder, spark, "plums")) == 3
    kb.clear(confirm=True)
    assert kb.load().count() == 0


def test_copies_are_hits_of_their_own(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    docs = documents(spark, a="apples and pears grow here")
    ingest_documents(docs, kb, mode="append")
    encoder = ingest_documents(docs, kb, mode="append").encoder
    ingest_documents(documents(spark, a="quite another text"), kb, mode="append")
    hits = ask(kb, encoder, spark, "apples and pears grow here", 2)
    assert [(h.text, h.rank) for h in hits] == [("apples and pears grow here", 1), ("apples and pears grow here", 2)]
    hits = ask(kb, encoder, spark, "apples and pears grow here", 3)
    assert [h.text for h in hits] == ["apples and pears grow here"] * 2 + ["quite another text"]


def test_raw_text_can_be_ingested(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    rows = spark.createDataFrame([(1, "some text that is long enough", "notes"), (2, "short", "notes")], "id int, text string, source string")
    done = ingest_documents(direct_text(rows, "text", "id", "source"), kb)
    assert done.summary.first().total_chunks == 1 and ask(kb, done.encoder, spark, "long text")[0].source == "notes"


def test_element_parser_agrees(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HARD_PAGES[:2])], "page_id int, html string")
    assert parse_pages(frame).count() == 2


def test_many_open_tags_take_linear_time():
    import time

    from corpusmill.operators.elements import read_page

    started = time.process_time()
    page = read_page("<form><ul>" + "<li>x" * 60_000 + "</form>after")
    assert time.process_time() - started < 10
    assert len(page["elements"]) == 60_002 and page["elements"][-1]["form_idx"] == 0


def test_parts_of_one_file_are_drawn_by_all_cores(spark):
    drawn = QUERIES["gen_bounds_one_sided"](spark, SMALL)
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tasks_of_rows_that_become_many_are_small(spark, monkeypatch):
    monkeypatch.setattr(session, "FEW_ROWS", 100)
    rows = spark.range(1000).coalesce(1)
    sizes = session.finely(rows, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 200
    assert session.finely(rows.limit(50), "id").count() == 50 and session.finely(rows.limit(0), "id").count() == 0
