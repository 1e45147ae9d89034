import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.encoders import HashingEncoder, model_encoder
from corpusmill.operators import generation
from corpusmill.plans import answers, ingest
from corpusmill.session import scratch_dir
from corpusmill.sources import exports, files
from corpusmill.sources.knowledge_base import KnowledgeBase, consistency
from corpusmill.streaming import incremental


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "sub").mkdir()
    (root / "plain.txt").write_bytes(b"first line\r\nbad \xff byte about refunds and returns")
    (root / "UPPER.MD").write_text("# Heading\nDiscount codes are checked at the checkout.")
    (root / "good.json").write_text('{"b": 1, "a": "é"}', encoding="utf-8")
    (root / "broken.json").write_text('{"b": ')
    (root / "page.html").write_text("<title>T</title><p>Shipping takes three days</p><script>x</script>")
    (root / "blank.txt").write_text(" \n")
    (root / "table.xlsx").write_bytes(b"zip")
    (root / "paper.pdf").write_bytes(b"%PDF 42 pages")
    (root / "sub" / "deep.txt").write_text("deep text about invoices")
    return str(root)


def test_scan(spark, folder):
    names = lambda df: sorted(r.filename for r in files.file_metadata(df).collect())
    flat = names(files.scan_files(spark, folder, recursive=False))
    assert flat == ["UPPER.MD", "blank.txt", "broken.json", "good.json", "page.html", "plain.txt"]
    assert names(files.scan_files(spark, folder)) == sorted([*flat, "deep.txt"])
    assert names(files.scan_files(spark, folder, extensions=[".md"])) == ["UPPER.MD"]
    assert names(files.scan_files(spark, folder, extensions=["nope"])) == []
    meta = files.file_metadata(files.scan_files(spark, folder, extensions=["md"])).first()
    assert (meta.extension, meta.created) == (".md", None) and meta.file_size_bytes > 10 and meta.modified is not None
    with pytest.raises(FileNotFoundError, match="Directory not found"):
        files.scan_files(spark, folder + "/missing")


def test_parse(spark, folder):
    all_files = files.scan_files(spark, folder, extensions=[*files.PARSER_EXTENSIONS, "xlsx"])
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.parse_files(all_files).collect()}
    assert rows["plain.txt"].text == "first line\nbad  byte about refunds and returns"
    assert rows["good.json"].text == json.dumps({"b": 1, "a": "é"}, indent=2, ensure_ascii=False)
    assert (rows["broken.json"].text, rows["broken.json"].success) == ("", False) and rows["broken.json"].error
    assert rows["page.html"].text == "T\nShipping takes three days"
    assert (rows["blank.txt"].text, rows["blank.txt"].success) == (" \n", True)
    assert rows["table.xlsx"].error == "Unsupported file format: .xlsx"
    assert rows["paper.pdf"].error == "Unsupported file format: .pdf"
    summary = files.parse_summary(files.parse_files(all_files)).first()
    assert tuple(summary) == (9, 6, 3)


def test_own_extractor_and_missing(spark, folder):
    def broken(_):
        raise ValueError("cannot read")

    found = files.scan_files(spark, folder, extensions=["pdf", "txt"])
    parsed = files.parse_files(found, {"pdf": lambda raw: raw.decode().upper(), "docx": broken})
    rows = {r.path.rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert (rows["paper.pdf"].text, rows["paper.pdf"].success) == ("%PDF 42 PAGES", True)
    bad = files.parse_files(found, {"pdf": broken, "docx": broken})
    assert {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()}["paper.pdf"] == "cannot read"
    wanted = parsed.select("path").unionByName(spark.createDataFrame([("gone.txt",)], "path string"))
    lost = files.with_missing(wanted, parsed).filter("path = 'gone.txt'").first()
    assert (lost.success, lost.error, lost.text) == (False, "File not found: gone.txt", "")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, chunk_id int, text string, embedding array<double>")


def test_knowledge_base(spark):
    kb = KnowledgeBase(spark, scratch_dir(spark, "kb-test"), dimension=2)
    assert not kb.exists() and kb.stats().first().total_vectors == 0
    with pytest.raises(FileNotFoundError):
        kb.load()
    batch = vectors(spark, [("a", 0, "x", [1.0, 0.0]), ("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", [0.0, 1.0])])
    kb.add(batch)
    kb.add(batch)
    kb.add(vectors(spark, [("a", 1, "changed", [0.0, 1.0])]))
    assert {(r.chunk_id, r.text) for r in kb.load().collect()} == {(0, "x"), (1, "changed")}
    kb.add(batch, mode="append")
    assert kb.stats().first().total_vectors == 5
    with pytest.raises(Exception, match="embedding must have 2 values, got 3"):
        kb.add(vectors(spark, [("b", 0, "z", [1.0, 0.0, 0.0])]))
    assert kb.load().count() == 5
    assert kb.metadata_of("a", 0).count() == 3 and kb.metadata_of("zz", 0).count() == 0
    assert "embedding" not in kb.metadata().columns
    with pytest.raises(ValueError):
        kb.clear()
    kb.clear(confirm=True)
    assert kb.load().count() == 0 and kb.stats().first().index_exists


def test_consistency(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(consistency(left, right, ["k"]).first()) == (3, 2, 1, 1, False)
    assert consistency(right, right, ["k"]).first().consistent


def test_merge_metadata(spark):
    row = spark.sql("select map('a','1','b','2') m, map('b','3','c','4') n, cast(null as map<string,string>) z")
    got = row.select(files.merge_metadata(F.col("m"), F.col("n")), files.merge_metadata(F.col("m"), F.col("z"))).first()
    assert got[0] == {"a": "1", "b": "3", "c": "4"} and got[1] == {"a": "1", "b": "2"}


def test_ingest_directory_end_to_end(spark, folder):
    kb = KnowledgeBase(spark, scratch_dir(spark, "kb-ingest"))
    done = ingest.ingest_directory(spark, folder, kb, extra={"source": "manuals"})
    assert tuple(done.summary.first()) == (7, 5, 2, 5)
    errors = {r.file_name: r.error for r in done.results.collect()}
    assert errors["blank.txt"] == ingest.NO_TEXT and errors["plain.txt"] is None and errors["broken.json"]
    assert {r.source for r in kb.load().collect()} == {"manuals"}
    encoder = HashingEncoder.fit(kb.load())
    queries = encoder.encode(spark.createDataFrame([(1, "Discount codes at the checkout"), (2, "invoices")], "query_id bigint, query string"), "query")
    best = {r.query_id: r.filename for r in answers.retrieve(queries, kb.load(), 1).collect()}
    assert best[1] == "UPPER.MD" and best[2] == "deep.txt"
    ingest.ingest_directory(spark, folder, kb, extra={"source": "manuals"})
    assert kb.load().count() == 5
    missing = ingest.ingest_directory(spark, folder + "/none", kb)
    assert missing.error.startswith("Directory not found") and tuple(missing.summary.first()) == (0, 0, 0, 0)


def test_stream_equals_batch(spark, folder):
    batch = KnowledgeBase(spark, scratch_dir(spark, "kb-batch"), dimension=64)
    ingest.ingest_directory(spark, folder, batch, recursive=True)
    encoder = HashingEncoder.fit(batch.load(), dimension=64)
    kb = KnowledgeBase(spark, scratch_dir(spark, "kb-stream"), dimension=64)
    checkpoint = scratch_dir(spark, "stream-checkpoint")
    for _ in range(2):  # the second run finds nothing new
        chunks = incremental.stream_chunks(incremental.documents_of(incremental.stream_files(spark, folder)))
        incremental.ingest_stream(chunks, kb, encoder, checkpoint).awaitTermination()
    key = lambda r: (r.doc_key.split(":")[-1].lstrip("/"), r.chunk_id, r.text, r.total_chunks)
    assert sorted(map(key, kb.load().collect())) == sorted(map(key, batch.load().collect()))


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "red red blue"), (2, "green"), (3, ""), (4, None)], "id int, text string")
    encoder = HashingEncoder.fit(texts, dimension=16)
    path = scratch_dir(spark, "encoder")
    encoder.save(spark, path)
    for one in (encoder, HashingEncoder.load(spark, path)):
        rows = {r.id: r.embedding for r in one.encode(texts).collect()}
        assert len(rows[1]) == 16 and abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and set(rows[3]) == {0.0} == set(rows[4])

    def make():
        import numpy as np
        return lambda batch: np.array([[len(t), 1.0] for t in batch], dtype="float32")

    got = texts.filter("id < 3").select("id", model_encoder(make, F.col("text"), batch_size=2).alias("v")).orderBy("id").collect()
    assert abs(got[0].v[0] / got[0].v[1] - 12) < 1e-4 and abs(got[1].v[0] ** 2 + got[1].v[1] ** 2 - 1) < 1e-6


def test_generation_and_usage(spark):
    def flaky():
        seen = {}

        def call(system, user):
            seen[user] = seen.get(user, 0) + 1
            if user == "never" or (user == "second" and seen[user] == 1):
                raise RuntimeError("busy")
            return f'[{{"test_id": "{user}"}}]', 5

        return call

    prompts = spark.createDataFrame([(1, "s", "first"), (2, "s", "second"), (3, "s", "never")], "query_id int, system string, user string")
    rows = {r.query_id: r for r in generation.generate(prompts, flaky, delay=0.0).collect()}
    assert (rows[1].attempts, rows[1].error, rows[1].tokens) == (1, None, 5)
    assert (rows[2].attempts, rows[2].response) == (2, '[{"test_id": "second"}]')
    assert (rows[3].attempts, rows[3].response, rows[3].error) == (3, None, "busy")
    assert len({r.prompt_key for r in rows.values()}) == 3
    log = spark.createDataFrame([("m", 3, 1), ("m", None, 2), ("n", 4, 3)], "model string, tokens int, t int")
    stats = {r.model: (r.total_requests, r.total_tokens_used) for r in generation.usage_stats(log, F.col("model"), F.col("tokens")).collect()}
    assert stats == {"m": (2, 3), "n": (1, 4)}
    since = generation.usage_stats(log, F.col("model"), F.col("tokens"), F.col("t") > 1)
    assert {r.model: r.total_tokens_used for r in since.collect()} == {"m": 0, "n": 4}


def test_answers_end_to_end(spark):
    chunks = spark.createDataFrame(
        [("d1", 0, "login needs a password", "a.md", None), ("d2", 0, "carts hold ten items", None, "wiki")],
        "doc_key string, chunk_id int, text string, filename string, source string",
    )
    encoder = HashingEncoder.fit(chunks, dimension=64)
    stored = encoder.encode(chunks)
    features = spark.createDataFrame([(1, "login password"), (2, "cart items")], "query_id int, query string")

    def model():
        return lambda system, user: ('[{"test_id": "T1", "test_steps": ["a", "b"]}]' if "login" in user.split("Feature")[1] else "no idea", 1)

    rows = {r.query_id: r for r in answers.generate_test_cases(features, stored, encoder, model, k=2).collect()}
    assert rows[1].status == "parsed" and rows[1].cases[0].test_steps == ["a", "b"] and rows[1].sources == ["a.md", "wiki"]
    assert rows[2].status == "raw" and rows[2].cases is None and rows[2].test_cases == "no idea"
    scripts = answers.generate_scripts(features.withColumn("structure_context", F.lit("page")), stored, encoder,
                                       lambda: lambda s, u: ("```python\nx = 1\n```", 1)).collect()
    assert {r.script for r in scripts} == {"x = 1"}


def test_equal_questions_are_searched_once(spark, monkeypatch):
    chunks = spark.createDataFrame([("d1", 0, "login needs a password", "a.md", None), ("d2", 0, "carts hold ten items", None, "wiki")],
                                   "doc_key string, chunk_id int, text string, filename string, source string")
    encoder = HashingEncoder.fit(chunks, dimension=64)
    asked = [(i, ("login password", "cart items", None)[i % 3], f"page {i}") for i in range(30)]
    searched, search = [], answers.retrieve

    def counted(queries, *rest):
        searched.append(queries.count())
        return search(queries, *rest)

    monkeypatch.setattr(answers, "retrieve", counted)
    told = answers.generate_scripts(spark.createDataFrame(asked, "query_id int, query string, structure_context string"), encoder.encode(chunks), encoder,
                                    lambda: lambda system, user: (user.split("Documentation:")[1], 1), k=1).collect()
    assert searched == [3] and sorted((r.query_id, r.structure_context) for r in told) == [(i, page) for i, _, page in asked]
    assert all(r.sources == [("a.md", "wiki", "a.md")[r.query_id % 3]] for r in told if r.query_id % 3 < 2)


def test_json_export(spark):
    rows = spark.createDataFrame([("valid", "a"), ("invalid", "b"), ("valid", None)], "kind string, value string")
    path = scratch_dir(spark, "json")
    exports.export_json(rows, path, by="kind")
    back = spark.read.schema(rows.schema).json(path)
    assert sorted((r.kind, r.value) for r in back.filter("value is not null").collect()) == [("invalid", "b"), ("valid", "a")]


def test_listing_asks_nothing_per_file_on_the_driver(spark, tmp_path, monkeypatch):
    names = ["a.txt", "_b.MD", ".c.txt", "x y/ü %20.txt", "_h/.d/e:f.md", "x y/no.bin", "plain"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * i)
    (tmp_path / "empty").mkdir()
    real = files.hadoop_files

    class NoListing:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            assert name != "listFiles"
            return getattr(self.system, name)

    def patched(spark, path):
        system, make = real(spark, path)
        return NoListing(system), make

    monkeypatch.setattr(files, "hadoop_files", patched)
    monkeypatch.setattr(files, "LIST_BATCH", 2)
    found = {r.path: r.length for r in files.list_folder(spark, str(tmp_path), True, ["txt", "md"]).collect()}
    assert found == {f"file:{tmp_path}/{n}": i for i, n in enumerate(names[:5])}
    top = files.list_folder(spark, str(tmp_path), False, ["txt", "md"])
    assert sorted(r.path.rsplit("/", 1)[-1] for r in top.collect()) == [".c.txt", "_b.MD", "a.txt"]
