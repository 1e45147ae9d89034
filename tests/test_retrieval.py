import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as vec
from corpusmill.operators import context, retrieval

SCHEMA = "doc string, part int, embedding array<float>"


def brute(queries, corpus, k):
    out = []
    for qid, q in queries:
        scored = sorted(
            (float(((np.float32(v).astype(float) - np.float32(q).astype(float)) ** 2).sum()), doc, part) for doc, part, v in corpus
        )
        out += [(qid, r + 1, doc, part, round(d, 9)) for r, (d, doc, part) in enumerate(scored[:k])]
    return sorted(out)


def shown(hits):
    return sorted((r.query_id, r.rank, r.doc, r.part, round(r.distance, 9)) for r in hits.collect())


def tables(spark, queries, corpus, parts=3):
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    return q, spark.createDataFrame(corpus, SCHEMA).repartition(parts)


@pytest.fixture
def random_rows():
    rng = np.random.default_rng(3)
    corpus = [(f"d{i % 40}", i, rng.normal(size=8).tolist()) for i in range(120)]
    hot = rng.normal(size=8).tolist()
    corpus += [(f"h{i % 7}", 1000 + i, hot) for i in range(80)]  # a hot group of equal vectors
    queries = [(i, rng.normal(size=8).tolist()) for i in range(9)] + [(99, hot)]
    return queries, corpus


@pytest.mark.parametrize("shipped", [True, False])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_knn_equals_brute_force(spark, random_rows, shipped, k, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    q, c = tables(spark, *random_rows)
    hits = retrieval.knn(q, c, ["doc", "part"], k, max_broadcast=100 if shipped else 0)
    assert shown(hits) == brute(*random_rows, k)


def test_block_plan_keeps_full_copies(spark):
    q, c = tables(spark, [(1, [0.0, 0.0])], [("a", 1, [1.0, 0.0])] * 4 + [("b", 2, [2.0, 0.0])])
    rows = retrieval.knn(q, c, ["doc", "part"], 5, max_broadcast=0).orderBy("rank").collect()
    assert [r.doc for r in rows] == ["a", "a", "a", "a", "b"]


def test_large_offsets_are_measured_exactly(spark):
    base = 1e4
    corpus = [("a", i, [base + i * 1e-3, base]) for i in range(50)]
    q, c = tables(spark, [(1, [base, base])], corpus)
    assert shown(retrieval.knn(q, c, ["doc", "part"], 4)) == brute([(1, [base, base])], corpus, 4)


def test_best_handles_many_ties_in_one_tile():
    import pyarrow as pa
    best = retrieval._Best(np.zeros((2, 3)), 2)
    best.add(pa.table({"key": list(range(400, 0, -1))}), np.ones((400, 3)))
    out = best.result(pa.array([7, 8]), pa.schema([("q", pa.int64()), ("key", pa.int64()), ("distance", pa.float64())]))
    assert out.to_pylist() == [{"q": q, "key": k, "distance": 3.0} for q in (7, 8) for k in (1, 2)]


def test_partitions_do_not_matter(spark, random_rows):
    results = [shown(retrieval.knn(*tables(spark, *random_rows, parts=n), ["doc", "part"], 7)) for n in (1, 16)]
    assert results[0] == results[1]


def test_empty_sides(spark):
    q, c = tables(spark, [(1, [1.0, 0.0])], [("a", 1, [1.0, 0.0])])
    none = c.filter("part > 5")
    for limit in (10, 0):
        assert retrieval.knn(q, none, ["doc", "part"], 3, max_broadcast=limit).count() == 0
        assert retrieval.knn(q.filter("query_id > 5"), c, ["doc", "part"], 3, max_broadcast=limit).count() == 0


def test_wrong_width_fails(spark):
    q, c = tables(spark, [(1, [1.0, 0.0])], [("a", 1, [1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="every embedding must have 2 values"):
        retrieval.knn(q, c, ["doc", "part"], 3).count()
    with pytest.raises(ValueError):
        retrieval.knn(q, c, ["doc", "part"], 0)


def test_self_hit_and_threshold_after_top_k(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0]), ("c", 3, [-1.0, 0.0])]
    q, c = tables(spark, [(1, [1.0, 0.0])], rows)
    hits = retrieval.knn(q, c, ["doc", "part"], 2)
    first = hits.filter("rank = 1").first()
    assert (first.doc, first.distance, first.similarity) == ("a", 0.0, 1.0)
    assert [r.doc for r in retrieval.threshold(hits, max_distance=1.0).collect()] == ["a"]
    assert retrieval.threshold(hits, min_similarity=0.0).count() == 2
    single = retrieval.nearest_to_vector(c, [1.0, 0.0], ["doc", "part"], 2).orderBy("rank").collect()
    assert [(r.doc, r.distance) for r in single] == [("a", 0.0), ("b", 2.0)]


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        vec.unit(F.col("a")).alias("unit"), vec.unit(F.col("z")).alias("no_unit"), vec.cosine(F.col("a"), F.col("a")).alias("same"),
        vec.cosine(F.col("a"), F.col("z")).alias("none"), vec.squared_l2(F.col("a"), F.col("z")).alias("d"),
    ).first()
    assert (row.unit, row.no_unit, round(row.same, 12), row.none, row.d) == ([0.6, 0.8], None, 1.0, None, 25.0)
    assert vec.max_distance(0.5) == 1.0 and vec.max_distance(0) == float("inf")


def test_context_shapes(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame(
        [(1, 2, "k2", 0.5, 0.6, "two", None, None), (1, 1, "k1", 0.1, 0.9, "one", "", "src"), (1, 3, "k3", 0.7, 0.5, "three", "f.txt", "src")],
        "query_id bigint, rank int, key string, distance double, similarity double, text string, filename string, source string",
    )
    got = {r.query_id: r for r in context.contexts(queries, hits).collect()}
    assert got[1].context == "[Source: ]\none\n\n---\n\n[Source: Unknown]\ntwo\n\n---\n\n[Source: f.txt]\nthree"
    assert got[1].sources == ["f.txt", "src"]
    assert got[2].context == context.NOTHING_FOUND and got[2].sources == []
    plain = {r.query_id: r.context for r in context.contexts(queries, hits, include_sources=False).collect()}
    assert plain[1] == "one\n\n---\n\ntwo\n\n---\n\nthree"
    summary = {r.query_id: r for r in context.retrieval_summary(queries, hits, ["key"]).collect()}
    assert [x.key for x in summary[1].results] == ["k1", "k2", "k3"] and summary[1].total_results == 3
    assert (summary[2].results, summary[2].total_results, summary[2].sources, summary[2].avg_similarity) == ([], 0, [], 0.0)


def test_texts_of_other_chunks_stay_where_they_are(spark, tmp_path):
    chunks = spark.range(20_000).select(F.col("id").alias("doc"), (F.col("id") % 3).alias("part"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks")).unionAll(chunks.where("doc = 40"))  # one chunk is stored twice
    hits = chunks.where("doc % 40 = 0").select(F.lit(1).alias("query_id"), "doc", "part", F.lit(0.5).alias("distance"))
    likely = retrieval.likely_hits(chunks, hits, ["doc", "part"])
    rows = {r.doc for r in likely.collect()}
    assert rows >= {r.doc for r in hits.collect()} and len(rows) < 520
    plan = likely._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = retrieval.attach_chunks(hits, chunks, ["doc", "part"]).collect()
    assert sorted(r.doc for r in got) == sorted([40, *range(0, 20_000, 40)]) and all(r.text == f"text {r.doc}" for r in got)
    assert retrieval.attach_chunks(hits.where("doc < 0"), chunks, ["doc", "part"]).count() == 0
    nulls = spark.createDataFrame([(1, None, 2, 0.5)], "query_id int, doc bigint, part bigint, distance double")
    assert retrieval.attach_chunks(nulls, chunks, ["doc", "part"]).count() == 0


def test_corpus_is_made_once_for_many_portions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "PORTION", 2)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, [float(i % 7), float(i * i % 11), 1.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hits = retrieval.knn(table.withColumnRenamed("vec_id", "query_id"), table.mapInArrow(count, table.schema), ["vec_id"], 3, max_broadcast=0).collect()
    assert made.value == 40
    for i, own in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(own, v)), j) for j, v in rows)[:3]
        assert sorted((h["distance"], h["vec_id"]) for h in hits if h["query_id"] == i) == near


def test_single_precision_only_nominates_and_few_tiles_are_sorted(monkeypatch):
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(32, 16))
    rows = rng.normal(size=(20000, 16))
    rows[7::50] = queries[3] + rng.normal(size=rows[7::50].shape) * 1e-9  # closer than single precision can tell
    rows[11::400] = rows[11]
    monkeypatch.setattr(retrieval, "_CELLS", 32 * 64)
    best, sorts = retrieval._Best(queries, 5), []
    keep = best._keep
    monkeypatch.setattr(best, "_keep", lambda table: sorts.append(1) or keep(table))
    ids = rng.permutation(len(rows))
    best.add(pa.table({"doc": ids}), rows)
    schema = pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("distance", pa.float64())])
    found = best.result(pa.array(range(32)), schema).to_pylist()
    for q in range(32):
        distance = ((rows - queries[q]) ** 2).sum(axis=1)
        order = np.lexsort((ids, distance))[:5]
        assert [(r["doc"], r["distance"]) for r in found if r["query_id"] == q] == [(ids[i], distance[i]) for i in order]
    assert len(sorts) < 40  # of 313 tiles


def test_the_length_of_a_vector_is_computed_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "v array<double>").select(vec.unit(F.col("v")).alias("u"))
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], None, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1


def test_rows_are_compared_with_some_queries_only():
    rng = np.random.default_rng(3)
    queries, rows = rng.normal(size=(9, 4)), np.repeat(rng.normal(size=(40, 4)), 3, axis=0)
    keys, only = pa.table({"key": np.arange(len(rows))}), np.array([1, 4, 7])
    best = retrieval._Best(queries, 5)
    best.add(keys.slice(0, 60), rows[:60], only)
    best.add(keys.slice(60), rows[60:])
    found = best.result(pa.array(np.arange(9)), pa.schema({"query_id": pa.int64(), "key": pa.int64(), "distance": pa.float64()})).to_pylist()
    for q in range(9):
        first = 0 if q in only else 60
        wanted = sorted((((rows[i] - queries[q]) ** 2).sum(), i) for i in range(first, len(rows)))[:5]
        assert sorted((r["distance"], r["key"]) for r in found if r["query_id"] == q) == wanted


def test_streamed_blocks_merge_hits_over_corpus_partitions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "PORTION", 1)
    monkeypatch.setattr(retrieval, "TASKS_PER_CORE", 1)
    rows = spark.range(200).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).repartition(10)
    asked = rows.where("key < 40").coalesce(1).withColumnRenamed("key", "query_id")
    fields = retrieval._hit_fields(asked, rows, "query_id", ["key"])
    assert retrieval._search_blocks(asked, rows, fields, "query_id", ["key"], "embedding", 3).count() == 40 * 3  # eight portions, four cores
