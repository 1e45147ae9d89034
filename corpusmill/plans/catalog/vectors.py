"""Vector math, nearest neighbours and what is built from hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import vectors as vec
from corpusmill.functions.encoders import HashingEncoder, encoded_sql
from corpusmill.operators import cells, context, retrieval
from corpusmill.operators.chunking import chunk_table, recursive_chunks
from corpusmill.plans import answers, fixtures
from corpusmill.plans.catalog.chunks import windows_sql
from corpusmill.plans.catalog.registry import query
from corpusmill.session import materialize, read_table, scratch_dir, spread

K = 5
HITS = fixtures.HITS_SQL.format(k=K)
CHUNK_HITS = f"""
    chunks AS MATERIALIZED ({fixtures.CHUNKS_SQL}),
    pairs AS (
        SELECT q.vec_id AS query_id, c.doc_key,
               power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
        FROM embeddings q CROSS JOIN chunks c),
    ranked AS (
        SELECT query_id, doc_key, distance, 1 / (1 + distance) AS similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key) AS rank
        FROM pairs QUALIFY rank <= {K}),
    hits AS (SELECT r.*, c.text, c.filename, c.source FROM ranked r JOIN chunks c USING (doc_key))"""
LISTED = "coalesce(nullif(filename, ''), nullif(source, ''))"


def _hits(spark, d, **options):
    e = read_table(spark, d, "embeddings")
    return retrieval.knn(fixtures.vector_queries(spark, d), e, ["vec_id"], K, **options)


def _rounded(hits):
    return hits.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id",
        F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"),
    )


def _chunk_hits(spark, d, **options):
    return answers.retrieve(fixtures.vector_queries(spark, d), fixtures.chunks(spark, d), K, **options)


@query("vec_unit", """
    SELECT vec_id, i - 1 AS pos,
           round(embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label <> 9)""")
def vec_unit(spark, d):
    """Scaled vectors back to unit length; those scaled to zero have no direction and no rows."""
    scale = F.when(F.col("label") == 9, 0.0).otherwise(F.col("label") + 1.0)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale)
    return read_table(spark, d, "embeddings").select("vec_id", F.posexplode(vec.unit(scaled)).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


def _neighbours(spark, d):
    e = read_table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id")


@query("vec_cosine", """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_cosine(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("vec_l2_similarity", """
    SELECT a.vec_id, round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 6) AS distance,
           round(1 / (1 + power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_l2_similarity(spark, d):
    distance = vec.squared_l2(F.col("embedding"), F.col("other"))
    return _neighbours(spark, d).select(
        "vec_id", F.round(distance, 6).alias("distance"), F.round(vec.similarity(distance), 6).alias("similarity")
    )


@query("vec_max_distance", """
    SELECT vec_id, round(1 / abs(embedding[1]::DOUBLE) - 1, 4) AS max_distance FROM embeddings
    WHERE embedding[1] <> 0""")
def vec_max_distance(spark, d):
    wanted = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return read_table(spark, d, "embeddings").filter(F.get("embedding", F.lit(0)) != 0).select(
        "vec_id", F.round(vec.max_distance(wanted), 4).alias("max_distance")
    )


@query("vec_dimensions", """
    SELECT len(embedding)::BIGINT AS dimension, count(*) AS vectors,
           count(*) FILTER (WHERE len(embedding) <> 64) AS violations
    FROM embeddings GROUP BY 1""")
def vec_dimensions(spark, d):
    size = F.size("embedding").cast("bigint")
    return read_table(spark, d, "embeddings").groupBy(size.alias("dimension")).agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.size("embedding") != 64).alias("violations")
    )


@query("knn_single", f"""
    WITH target AS (
        SELECT list(m ORDER BY i) AS q FROM (
            SELECT i, avg(embedding[i]::DOUBLE) AS m
            FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i)),
    near AS (
        SELECT vec_id, power(list_distance(embedding::DOUBLE[], q), 2) AS distance FROM embeddings, target
        ORDER BY distance, vec_id LIMIT {K})
    SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, round(distance, 6) AS distance,
           round(1 / (1 + distance), 6) AS similarity FROM near""")
def knn_single(spark, d):
    """The vectors nearest to the mean vector of the table."""
    e = read_table(spark, d, "embeddings")
    width = len(e.select("embedding").first()[0])
    mean = e.agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(width)]).first()
    return retrieval.nearest_to_vector(e, list(mean), ["vec_id"], K).select(
        F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
    )


KNN_SQL = f"""
    WITH {HITS}
    SELECT query_id, rank, vec_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM hits"""


@query("knn_batch", KNN_SQL)
def knn_batch(spark, d):
    """Every vector as a query against all vectors (the queries are shipped to the corpus)."""
    return _rounded(_hits(spark, d))


@query("knn_blocks", KNN_SQL)
def knn_blocks(spark, d):
    """The same with the plan for query tables too large to ship."""
    return _rounded(_hits(spark, d, max_broadcast=0))


@query("knn_threshold", f"""
    WITH {HITS}
    SELECT query_id, rank, vec_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity
    FROM hits WHERE distance <= 1.4 AND similarity >= 0.43""")
def knn_threshold(spark, d):
    return _rounded(retrieval.threshold(_hits(spark, d), 1.4, 0.43))


@query("knn_cells_exact", f"""
    WITH {HITS} SELECT query_id, rank, vec_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM hits""")
def knn_cells_exact(spark, d):
    """Every vector against the vectors stored by cell, with as many cells as certainty takes."""
    index = cells.CellIndex.build(read_table(spark, d, "embeddings"), scratch_dir(spark, "cells"), ["vec_id"])
    return _rounded(index.search(fixtures.vector_queries(spark, d), K))


@query("knn_cells_recall", f"""
    WITH {HITS} SELECT count(DISTINCT query_id) AS queries, count(*) AS hits, true AS recall_reached, true AS distances_right FROM hits""")
def knn_cells_recall(spark, d):
    """The same with a calibrated number of probes: share of the exact hits found, and the distances of those."""
    index = cells.CellIndex.build(read_table(spark, d, "embeddings"), scratch_dir(spark, "cells"), ["vec_id"])
    queries = fixtures.vector_queries(spark, d)
    found = index.search(queries, K, index.calibrate(queries, K, target=0.93)).select("query_id", "vec_id", F.col("distance").alias("near"))
    both = _hits(spark, d).join(found, ["query_id", "vec_id"], "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"),
        (F.count("near") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
        F.bool_and(F.coalesce(F.abs(F.col("near") - F.col("distance")) < 1e-9, F.lit(True))).alias("distances_right"))


@query("knn_best_other", f"""
    WITH {HITS}
    SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM hits WHERE vec_id <> query_id
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) = 1""")
def knn_best_other(spark, d):
    """The most similar other vector of every vector."""
    others = _hits(spark, d).filter(F.col("vec_id") != F.col("query_id"))
    return retrieval.most_similar(others, "vec_id").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("retrieve_chunks", f"""
    WITH {CHUNK_HITS}
    SELECT query_id, rank, doc_key, round(distance, 6) AS distance, text, {LISTED} AS source_name FROM hits""")
def retrieve_chunks(spark, d):
    """Hits with the text and the listed source of their chunk."""
    return _chunk_hits(spark, d).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_key", F.round("distance", 6).alias("distance"),
        "text", context.listed_source(F.col("filename"), F.col("source")).alias("source_name"),
    )


@query("retrieve_many", f"""
    WITH {CHUNK_HITS}
    SELECT query_id, rank, doc_key, round(distance, 6) AS distance, text, filename, source FROM hits""")
def retrieve_many(spark, d):
    """The same by the plans for query tables of any size: streamed blocks, and texts looked up behind a filter of hit keys."""
    return _chunk_hits(spark, d, max_broadcast=0).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_key", F.round("distance", 6).alias("distance"), "text", "filename", "source")


@query("retrieve_min_similarity", f"""
    WITH {CHUNK_HITS}
    SELECT query_id, rank, doc_key, round(similarity, 6) AS similarity FROM hits WHERE distance <= 1 / 0.42 - 1""")
def retrieve_min_similarity(spark, d):
    return _chunk_hits(spark, d, min_similarity=0.42).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_key", F.round("similarity", 6).alias("similarity")
    )


@query("ctx_sources", f"""
    WITH {CHUNK_HITS}
    SELECT q.vec_id AS query_id, coalesce(string_agg(DISTINCT {LISTED}, '|' ORDER BY {LISTED}), '') AS sources
    FROM embeddings q LEFT JOIN (SELECT * FROM hits WHERE distance BETWEEN 0.3 AND 1.2) h ON h.query_id = q.vec_id GROUP BY q.vec_id""")
def ctx_sources(spark, d):
    """Source lists of the hits in a band of distances; queries that have none keep an empty list."""
    near = _chunk_hits(spark, d).where(F.col("distance").between(0.3, 1.2))
    return context.relevant_sources(near, queries=fixtures.vector_queries(spark, d)).select("query_id", F.array_join("sources", "|").alias("sources"))


@query("ctx_summary", f"""
    WITH {CHUNK_HITS}, near AS (SELECT * FROM hits WHERE distance BETWEEN 0.05 AND 1.15)
    SELECT q.vec_id AS query_id, coalesce(string_agg(doc_key::VARCHAR, ',' ORDER BY rank), '') AS results,
           count(doc_key) AS total_results,
           coalesce(string_agg(DISTINCT {LISTED}, '|' ORDER BY {LISTED}), '') AS sources,
           round(coalesce(avg(similarity), 0), 6) AS avg_similarity
    FROM embeddings q LEFT JOIN near ON near.query_id = q.vec_id GROUP BY q.vec_id""")
def ctx_summary(spark, d):
    """Summary per query without its own vector; queries left without hits by the thresholds keep a zero row."""
    queries = fixtures.vector_queries(spark, d)
    near = retrieval.threshold(_chunk_hits(spark, d), max_distance=1.15).where("distance >= 0.05")
    return context.retrieval_summary(queries.select("query_id"), near, ["doc_key"]).select(
        "query_id", F.array_join(F.transform("results", lambda r: r["doc_key"].cast("string")), ",").alias("results"),
        "total_results", F.array_join("sources", "|").alias("sources"), F.round("avg_similarity", 6).alias("avg_similarity"),
    )


@query("ctx_assemble", f"""
    WITH {CHUNK_HITS}, near AS (SELECT * FROM hits WHERE distance <= 1.3)
    SELECT q.vec_id AS query_id,
           coalesce(string_agg('[Source: ' || coalesce(filename, source, 'Unknown') || ']' || chr(10) || coalesce(text, ''),
                               chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank),
                    'No relevant information found in the knowledge base.') AS context,
           coalesce(string_agg(DISTINCT {LISTED}, '|' ORDER BY {LISTED}), '') AS sources
    FROM embeddings q LEFT JOIN near ON near.query_id = q.vec_id GROUP BY q.vec_id""")
def ctx_assemble(spark, d):
    near = retrieval.threshold(_chunk_hits(spark, d), max_distance=1.3)
    return context.contexts(fixtures.vector_queries(spark, d).select("query_id"), near).withColumn(
        "sources", F.array_join("sources", "|")
    )


def _document_chunks(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    chunks = chunk_table(docs.select(F.col("doc_id").alias("doc_key"), "source", "text"), recursive_chunks(F.col("text"), separators=[""]))
    return chunks.withColumn("filename", F.lit(None).cast("string"))


DOCUMENT_CHUNKS_SQL = f"(SELECT w.doc_id AS doc_key, w.chunk_id, w.text, d.source, NULL::VARCHAR AS filename FROM ({windows_sql(1000, 200)}) w JOIN documents d USING (doc_id))"


def text_hits_sql(asked: str, k: int) -> str:
    """CTEs up to ``hits``: the ``k`` nearest encoded chunks of every row of ``asked(query_id, query)``."""
    return f"""
    doc_chunks AS MATERIALIZED (SELECT * FROM {DOCUMENT_CHUNKS_SQL}),
    encoded AS MATERIALIZED ({encoded_sql("doc_chunks", "doc_key, chunk_id", "text", "doc_chunks")}),
    asked AS MATERIALIZED ({asked}),
    asked_vectors AS MATERIALIZED ({encoded_sql("asked", "query_id", "query", "doc_chunks")}),
    near AS (
        SELECT query_id, doc_key, chunk_id, power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
        FROM asked_vectors q CROSS JOIN encoded c),
    hits AS (
        SELECT query_id, n.doc_key, n.chunk_id, distance, rank, c.text, c.source, c.filename
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key, chunk_id) AS rank FROM near QUALIFY rank <= {k}) n
        JOIN doc_chunks c ON c.doc_key = n.doc_key AND c.chunk_id = n.chunk_id)"""


@query("vec_encode", f"""
    SELECT doc_id, len(embedding) AS dimension, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm,
           round(list_inner_product(embedding::DOUBLE[], range(1, 385)::DOUBLE[]), 3) AS digest, round(list_max(embedding)::DOUBLE, 5) AS largest
    FROM ({encoded_sql("documents", "doc_id", "text", "documents")})""")
def vec_encode(spark, d):
    """Default encoder over every document: width, length, and two figures that depend on every value."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    encoded = materialize(HashingEncoder.fit(docs).encode(docs).select("doc_id", "embedding"), "encoded")
    places = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return encoded.select(
        "doc_id", F.size("embedding").cast("bigint").alias("dimension"), F.round(vec.norm(F.col("embedding")), 4).alias("norm"),
        F.round(F.aggregate(places, F.lit(0.0), lambda n, x: n + x), 3).alias("digest"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("largest"),
    )


@query("retrieve_texts", f"""
    WITH {text_hits_sql("SELECT item_id AS query_id, text AS query FROM benchmark", K)}
    SELECT query_id, rank, doc_key, chunk_id::BIGINT AS chunk_id, round(1 / (1 + distance), 4) AS similarity, source FROM hits""")
def retrieve_texts(spark, d):
    """Texts as queries against the encoded chunks of every document."""
    chunks = materialize(_document_chunks(spark, d), "chunks")
    encoder = HashingEncoder.fit(chunks)
    queries = encoder.encode(read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query")
    return answers.retrieve(queries, encoder.encode(chunks), K).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_key", F.col("chunk_id").cast("bigint").alias("chunk_id"),
        F.round("similarity", 4).alias("similarity"), "source",
    )
