import os
import time

from pyspark.sql import functions as F

from corpusmill.operators import generation
from corpusmill.operators.chunking import fixed_chunks
from corpusmill.plans.catalog.streams import stream_chunks, stream_file_status, stream_usage_reset  # noqa: F401
from corpusmill.session import scratch_dir
from corpusmill.sources import files
from corpusmill.streaming import incremental

DOCS = "doc_key string, filename string, text string, success boolean, error string"
LOG = "model string, tokens long, at timestamp, is_reset boolean"


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_both_outputs_once(spark):
    path, out = scratch_dir(spark, "in"), incremental.StreamedDocuments(spark, scratch_dir(spark, "out"))

    def run():
        docs = spark.readStream.schema(DOCS).parquet(path)
        out.write(docs, 10, 2, [""]).awaitTermination()

    append(spark, path, [("a", "a.md", "0123456789abc", True, None), ("b", "b.md", " ", True, None), ("c", "c.md", "", False, "cannot read")], DOCS)
    run()
    append(spark, path, [("d", "d.md", "later", True, None)], DOCS)
    run()
    run()  # nothing new
    states = {r.doc_key: (r.success, r.error, r.n_chunks) for r in out.status().collect()}
    assert states == {"a": (True, None, 2), "b": (False, "No text content found", 0), "c": (False, "cannot read", 0), "d": (True, None, 1)}
    assert sorted((r.doc_key, r.chunk_id, r.text) for r in out.chunks().collect()) == [("a", 0, "0123456789"), ("a", 1, "89abc"), ("d", 0, "later")]
    # an attempt that broke off between the two outputs shows nothing, and its repetition takes its place
    out.chunks().limit(1).write.parquet(f"{out.path}/chunks/batch=7")
    assert out.chunks().count() == 3


def test_resets_in_any_order(spark):
    path = scratch_dir(spark, "log")
    at = lambda m: f"2024-01-01 00:{m:02d}:10"
    cast = lambda rows: spark.createDataFrame(rows, "model string, tokens long, at string, is_reset boolean").withColumn("at", F.to_timestamp("at"))
    for rows in ([("m", 5, at(1), False), ("m", 7, at(5), False), ("n", 1, at(1), False)],
                 [("m", None, at(3), True), ("m", 100, at(2), False)],  # the reset comes late, and an older request later still
                 [("m", 9, at(9), False), ("n", None, at(8), True)]):
        cast(rows).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    counters = incremental.usage_stream_with_resets(log, F.col("model"), F.col("tokens"), F.col("at"), F.col("is_reset"))
    rows = {r.model: (r.total_requests, r.total_tokens_used) for r in incremental.latest_update(counters, "model", "reset-test").collect()}
    assert rows == {"m": (2, 16), "n": (0, 0)}


def test_stored_responses(spark):
    calls = scratch_dir(spark, "calls")
    os.makedirs(calls)

    def model():
        def call(system, user):
            with open(f"{calls}/{user}", "a") as f:
                f.write("x")
            if user == "bad":
                raise RuntimeError("no")
            return user.upper(), 3

        return call

    made = lambda n: len(open(f"{calls}/{n}").read()) if os.path.exists(f"{calls}/{n}") else 0
    store = generation.ResponseStore(spark, scratch_dir(spark, "store"))
    prompts = lambda *rows: spark.createDataFrame(rows, "query_id int, system string, user string")
    first = {r.query_id: r for r in store.generate(prompts((1, "s", "a"), (2, "s", "a"), (3, "s", "bad")), model, delay=0.0).collect()}
    assert (first[1].response, first[1].attempts, first[2].response, first[2].attempts) == ("A", 1, "A", 0) and first[3].error == "no" and first[3].attempts == 3
    again = {r.query_id: r for r in store.generate(prompts((1, "s", "a"), (3, "s", "bad"), (4, "t", "b"), (5, None, None)), model, delay=0.0).collect()}
    assert again[1].from_store and again[1].response == "A" and again[1].tokens == 0 and not again[3].from_store and again[4].response == "B"
    assert (made("a"), made("b"), made("bad")) == (1, 1, 6)


def test_long_text_in_linear_time(spark):
    text = "ab c\U0001f600\n" * 666_667  # four million characters
    df = spark.createDataFrame([(text,)], "text string")
    df.select(F.size(fixed_chunks(F.col("text")))).first()
    started = time.time()
    chunks = df.select(fixed_chunks(F.col("text")).alias("c")).first().c
    assert time.time() - started < 6 and len(chunks) == 5000
    want = [w for w in (text[i:i + 1000].strip() for i in range(0, len(text) - 200, 800)) if w]
    assert chunks == want
    narrow = df.select(fixed_chunks(F.substring("text", 1, 500), 100, 90).alias("c")).first().c
    assert narrow == [w for w in (text[:500][i:i + 100].strip() for i in range(0, 401, 10)) if w]


def test_listing_is_complete(spark, tmp_path):
    (tmp_path / "_in" / ".deep").mkdir(parents=True)
    for name, body in {"a.md": "text", "_notes.md": "hidden text", ".hid.txt": "hid", "empty.md": "", "_in/b.txt": "in", "_in/.deep/ü %20 x.md": "odd", "c.bin": "no"}.items():
        (tmp_path / name).write_text(body)
    rows = {r.path.split(str(tmp_path) + "/")[1]: r for r in files.parse_files(files.scan_files(spark, str(tmp_path))).collect()}
    assert {k: r.text for k, r in rows.items()} == {"a.md": "text", "_notes.md": "hidden text", ".hid.txt": "hid", "empty.md": "", "_in/b.txt": "in", "_in/.deep/ü %20 x.md": "odd"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path), recursive=False).collect()) == [".hid.txt", "_notes.md", "a.md", "empty.md"]


def test_tables_that_are_folders_of_files(spark):
    where = scratch_dir(spark, "folders")
    docs = [(i, f"text {i}" if i % 3 else None) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{where}/documents.parquet")
    assert sorted(r.doc_id for r in stream_chunks(spark, where).collect()) == [i for i, t in docs if t]
    states = {r.doc_key: (r.success, r.stored_chunks) for r in stream_file_status(spark, where).collect()}
    assert states == {str(i): (bool(t and i % 7), int(bool(t and i % 7))) for i, t in docs}
