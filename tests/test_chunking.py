import tracemalloc

import hypothesis.strategies as st
import pyarrow as pa
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from corpusmill.operators import chunking, positions


def plain_split(text, separators, size, overlap):
    """List-based statement of the published splitting rule, for comparison only."""
    chosen, finer = separators[-1], []
    for i, sep in enumerate(separators):
        if sep == "" or sep in text:
            chosen, finer = sep, ([] if sep == "" else separators[i + 1:])
            break
    if chosen == "":
        pieces = list(text)
    else:
        head, *tail = text.split(chosen)
        pieces = [p for p in [head, *[chosen + t for t in tail]] if p]
    out, good = [], []

    def flush():
        window, total = [], 0
        for piece in good:
            if total + len(piece) > size and window:
                out.append("".join(window).strip())
                while total > overlap or (total + len(piece) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(piece)
            total += len(piece)
        if window:
            out.append("".join(window).strip())
        good.clear()

    for piece in pieces:
        if len(piece) < size:
            good.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, finer, size, overlap) if finer else [piece])
    flush()
    return [c for c in out if c]


TEXTS = st.text(alphabet="ab .,;!?\né\U0001F600", max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(2, 30), st.integers(0, 12), st.sampled_from([chunking.SEPARATORS, [""], ["\n", " "], [". ", ""]]))
def test_split_equals_plain_rule(text, size, overlap, separators):
    overlap = min(overlap, size - 1)
    expected = plain_split(text, separators, size, overlap) if text.strip() else []
    chunks = chunking.split_text(text, separators, size, overlap)
    assert chunks == expected
    assert all(c in text for c in chunks)
    if separators[-1] == "":
        assert all(len(c) <= size for c in chunks)


def test_fixed_equals_recursive_characters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for row in docs.select("text", chunking.fixed_chunks(F.col("text"), 100, 30).alias("c")).collect():
        assert row.c == chunking.split_text(row.text, [""], 100, 30)


def test_recursive_column_and_numbering(spark):
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(9))
    docs = spark.createDataFrame([(1, text), (2, " \n "), (3, None), (4, "short")], "id int, text string")
    rows = chunking.chunk_table(docs, chunking.recursive_chunks(F.col("text"), 400, 50)).orderBy("id", "chunk_id").collect()
    expected = chunking.split_text(text, size=400, overlap=50)
    assert [r.text for r in rows if r.id == 1] == expected
    assert [r.chunk_id for r in rows if r.id == 1] == list(range(len(expected)))
    assert {r.total_chunks for r in rows if r.id == 1} == {len(expected)}
    assert all(r.chunk_size == len(r.text) for r in rows)
    assert [r.id for r in rows if r.id != 1] == [4]


@pytest.mark.parametrize("size,overlap", [(0, 0), (-5, 0), (100, -1), (200, 200), (10, 11)])
def test_settings_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_settings(size, overlap)


def test_zero_overlap_is_kept(spark):
    docs = spark.createDataFrame([("x" * 250,)], "text string")
    assert [len(c) for c in docs.select(chunking.fixed_chunks(F.col("text"), 100, 0)).first()[0]] == [100, 100, 50]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_positions_over_many_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(positions, "ROWS_PER_RANGE", 37)
    monkeypatch.setattr(positions, "EDGES_PER_GROUP", 4)
    ids = [(7 * i) % 1009 for i in range(1009)]
    rows = spark.createDataFrame([(i,) for i in ids], "k bigint").select(F.lpad(F.col("k").cast("string"), 5, "0").cast(kind).alias("k"))
    got = positions.with_position(rows.repartition(5), "k", "pos").orderBy("k").collect()
    assert [r.pos for r in got] == list(range(1009))


def test_document_index_counts_failed_documents(spark):
    docs = spark.createDataFrame(
        [("a", "text one", True, None), ("b", "", False, "bad"), ("c", "text two", True, None)],
        "doc_key string, text string, success boolean, error string",
    )
    rows = chunking.chunk_documents(docs).orderBy("document_index").collect()
    assert [(r.document_index, r.doc_key) for r in rows] == [(0, "a"), (2, "c")]


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert tuple(chunking.chunk_stats(empty).first()) == (0, 0.0, 0, 0, 0)


def test_a_batch_of_texts_takes_little_more_than_its_chunks():
    texts = pa.array(["some words, and more of them. " * 90, None, ""] * 4000)
    tracemalloc.start()
    made = chunking.split_texts(texts, size=40, overlap=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.slice(0, 3).to_pylist() == [chunking.split_text(texts[0].as_py(), size=40, overlap=0), None, []] and made.null_count == 4000
    assert peak < 8 << 20  # Python texts and chunks of a run, not of the batch
