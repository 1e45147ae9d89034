import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cells, retrieval
from corpusmill.session import scratch_dir


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(12, 8)) * 4
    rows = [(i, int(i % 3), (heads[i % 12] + rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(5000 + i, 0, heads[3].tolist()) for i in range(300)]  # a hot cell of equal vectors
    return spark.createDataFrame(rows, "doc long, part int, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, corpus):
    return cells.CellIndex.build(corpus, scratch_dir(spark, "cells"), ["doc", "part"], cells=24)


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("doc % 25 = 0").select(F.col("doc").alias("query_id"), "embedding")


def shown(hits):
    return sorted((r.query_id, r.rank, r.doc, r.part, round(r.distance, 9)) for r in hits.collect())


def test_exact_search_equals_knn(index, corpus, queries, monkeypatch):
    wanted = shown(retrieval.knn(queries, corpus, ["doc", "part"], 7))
    assert shown(index.search(queries, 7)) == wanted
    monkeypatch.setattr(cells, "ROWS_PER_TASK", 40)  # hot cells and hot queries in parts
    monkeypatch.setattr(cells, "QUERIES_PER_TASK", 3)
    assert shown(index.search(queries, 7)) == wanted
    assert shown(index.search(queries, 2000)) == shown(retrieval.knn(queries, corpus, ["doc", "part"], 2000))


def test_recall_grows_with_probes(index, corpus, queries):
    exact = retrieval.knn(queries, corpus, ["doc", "part"], 5).cache()
    shares = [cells.recall(exact, index.search(queries, 5, n), ["query_id", "doc", "part"]) for n in (1, 4, 24)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0
    found = index.calibrate(queries, 5, target=0.9)
    assert cells.recall(exact, index.search(queries, 5, found), ["query_id", "doc", "part"]) >= 0.9 and found < 24


def test_only_probed_cells_are_read(index):
    near = index.about()["cell"][:2].tolist()
    assert {f.split("/cell=")[1].split("/")[0] for f in index.load(near).inputFiles()} == {str(c) for c in near}
    one = index.load(near[:1])
    assert one.count() == dict(zip(index.about()["cell"].tolist(), index.about()["rows"].tolist()))[near[0]]
    assert len(one.inputFiles()) < len(index.load().inputFiles())


def test_rows_without_vectors_and_empty_tables(spark, queries):
    rows = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, []), (4, [0.0, 1.0])], "doc long, embedding array<float>")
    index = cells.CellIndex.build(rows, scratch_dir(spark, "cells-few"), ["doc"])
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<float>")
    assert [(r.doc, r["rank"]) for r in index.search(asked, 5).orderBy("rank").collect()] == [(2, 1), (4, 2)]
    assert index.search(asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        cells.CellIndex.build(rows.limit(0), scratch_dir(spark, "cells-none"), ["doc"])


def test_block_plan_moves_no_corpus_row(spark, index, queries):
    hits = retrieval.knn(queries, index.load(), ["doc", "part"], 3, max_broadcast=0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("CartesianProduct"):]  # the corpus and the query blocks
    assert "Exchange" not in below and "Generate" not in plan


def test_probes_are_made_in_small_batches(spark, index, queries, monkeypatch):
    monkeypatch.setattr(cells, "PROBES", 24 * 4)  # four queries at once
    seen = []

    def choose(distance, _):
        seen.append(distance.shape)
        assert len(distance) <= 4
        return np.ones(distance.shape, bool)

    assert index._probed(queries, "query_id", choose).count() == queries.count() * len(index.about()["cell"])


def test_centres_do_not_depend_on_how_many_rows_are_looked_at_once(corpus, monkeypatch):
    whole = cells.learn_centres(corpus, "embedding", 24)
    nearest, most = cells._nearest, []
    monkeypatch.setattr(cells, "PROBES", 24 * 100)
    monkeypatch.setattr(cells, "_nearest", lambda rows, centres: most.append(len(rows)) or nearest(rows, centres))
    assert np.allclose(cells.learn_centres(corpus, "embedding", 24), whole)
    assert max(most) <= 100


def test_a_query_is_written_once_whatever_it_probes(spark, index, corpus, queries, monkeypatch):
    written, write = [], cells.materialize

    def materialize(rows, purpose):
        made = write(rows, purpose)
        written.append(made.count())
        return made

    monkeypatch.setattr(cells, "materialize", materialize)
    every = index.search(queries, 7, 24)
    assert shown(every) == shown(retrieval.knn(queries, corpus, ["doc", "part"], 7))
    assert shown(index.search(queries, 7)) == shown(every)
    assert max(written) == queries.count()


def test_hits_of_all_cells_are_merged_in_the_tasks(index, queries, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_BLOCK", 1)  # as many portions as tasks are wanted
    hits = index.search(queries, 5, 24)
    below = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in below
    assert index._search(queries, "query_id", 5, lambda d, _: np.ones(d.shape, bool)).count() == 5 * queries.count()


@pytest.mark.parametrize("probes", [3, None])
def test_moved_and_streamed_queries_have_the_same_hits(index, queries, monkeypatch, probes):
    asked = queries.unionByName(queries.where("query_id < 300").withColumn("query_id", F.col("query_id") + 10_000))
    monkeypatch.setattr(cells, "MOVED_PROBES", 24)
    moved = shown(index.search(asked, 7, probes))
    monkeypatch.setattr(cells, "MOVED_PROBES", 0)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 7)
    monkeypatch.setattr(cells, "CORPUS_BLOCK", 90)
    assert shown(index.search(asked, 7, probes)) == moved
    monkeypatch.setattr(retrieval, "SHARE", 3)  # several shares of the cells
    monkeypatch.setattr(retrieval, "TASKS_PER_CORE", 1)
    assert shown(index.search(asked, 7, probes)) == moved


def test_queries_of_an_exact_search_are_made_once(spark, index, corpus, queries):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert shown(index.search(queries.mapInArrow(count, queries.schema), 7)) == shown(retrieval.knn(queries, corpus, ["doc", "part"], 7))
    assert made.value == queries.count()
