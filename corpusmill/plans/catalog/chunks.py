"""Chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank
from corpusmill.operators import chunking
from corpusmill.plans.catalog.registry import query
from corpusmill.session import read_table, spread

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def windows_sql(size: int, overlap: int, source: str = "documents", key: str = "doc_id") -> str:
    """Non-empty stripped windows with their number, by ``range`` and ``substr``."""
    step = size - overlap
    return f"""
        SELECT {key}, text, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS chunk_id,
               count(*) OVER (PARTITION BY {key}) AS total_chunks
        FROM (SELECT {key}, i, {strip_sql(f"substr(t, (i * {step} + 1)::BIGINT, {size})")} AS text
              FROM (SELECT {key}, text AS t, unnest(range(0, CASE WHEN length(text) <= {size} THEN 1
                           ELSE ceil((length(text) - {size}) / {step}.0)::BIGINT + 1 END)) AS i FROM {source}))
        WHERE text <> ''"""


def _docs(spark, d):
    return spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _shown(chunks):
    return chunks.select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.col("chunk_size").cast("bigint").alias("chunk_size"), "text",
    )


def _shown_sql(size: int, overlap: int) -> str:
    return f"SELECT doc_id, chunk_id, total_chunks, length(text) AS chunk_size, text FROM ({windows_sql(size, overlap)})"


@query("chunk_fixed", _shown_sql(1000, 200))
def chunk_fixed(spark, d):
    return _shown(chunking.chunk_table(_docs(spark, d), chunking.fixed_chunks(F.col("text"))))


@query("chunk_fixed_custom", _shown_sql(300, 50))
def chunk_fixed_custom(spark, d):
    """The general entry point with a single empty separator and other settings."""
    return _shown(chunking.chunk_table(_docs(spark, d), chunking.recursive_chunks(F.col("text"), 300, 50, [""])))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return _shown(chunking.chunk_table(_docs(spark, d), chunking.recursive_chunks(F.col("text"))))


@query("chunk_recursive_custom")
def chunk_recursive_custom(spark, d):
    chunks = chunking.recursive_chunks(F.col("text"), 400, 80, ["\n", ". ", " ", ""])
    return _shown(chunking.chunk_table(_docs(spark, d), chunks))


@query("chunk_recursive_cover", f"""
    SELECT doc_id, md5(regexp_replace(text, '{WS}', '', 'g')) AS characters_md5, length(regexp_replace(text, '{WS}', '', 'g')) AS n_characters,
           true AS numbered, true AS within_size, true AS whole_stretches
    FROM documents WHERE {strip_sql("text")} <> ''""")
def chunk_recursive_cover(spark, d):
    """Without overlap the chunks, in order, hold every character of a text that is no white space exactly once."""
    blank = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
    docs = _docs(spark, d)
    cut = docs.select("doc_id", "text", chunking.recursive_chunks(F.col("text"), 500, 0).alias("c")).where(F.size("c") > 0)
    held = F.regexp_replace(F.array_join("c", ""), blank, "")
    rows = chunking.chunk_table(cut.select("doc_id", F.lit("").alias("text"), "c"), F.col("c")).drop("c").groupBy("doc_id").agg(
        ((F.max("chunk_id") + 1 == F.count(F.lit(1))) & (F.max("total_chunks") == F.count(F.lit(1)))).alias("numbered"), (F.max("chunk_size") <= 500).alias("within_size"))
    return cut.select("doc_id", F.md5(held).alias("characters_md5"), F.length(held).cast("bigint").alias("n_characters"),
                      F.forall("c", lambda c: F.contains("text", c)).alias("whole_stretches")).join(rows, "doc_id")


CHUNK_STATS_SQL = """
    SELECT count(*) AS total_chunks, round(coalesce(avg(length(text)), 0), 6) AS avg_chunk_size,
           coalesce(min(length(text)), 0) AS min_chunk_size, coalesce(max(length(text)), 0) AS max_chunk_size,
           coalesce(sum(length(text)), 0)::BIGINT AS total_characters FROM ({chunks})"""


def _stats(chunks):
    return chunking.chunk_stats(chunks).withColumn("avg_chunk_size", F.round("avg_chunk_size", 6))


@query("chunk_stats", CHUNK_STATS_SQL.format(chunks=windows_sql(1000, 200)))
def chunk_stats(spark, d):
    return _stats(chunking.chunk_table(_docs(spark, d), chunking.fixed_chunks(F.col("text"))))


@query("chunk_stats_recursive")
def chunk_stats_recursive(spark, d):
    return _stats(chunking.chunk_table(_docs(spark, d), chunking.recursive_chunks(F.col("text"))))


def _parsed(spark, d):
    """Documents as parse results; those labelled toxic count as failed."""
    labels = read_table(spark, d, "labels").select("doc_id", "toxic")
    return read_table(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "text", (F.coalesce("toxic", F.lit(0)) == 0).alias("success"), F.lit(None).cast("string").alias("error")
    )


PARSED_SQL = "SELECT d.doc_id, d.text, coalesce(l.toxic, 0) = 0 AS success FROM documents d LEFT JOIN labels l USING (doc_id)"


@query("chunk_document_index", f"""
    WITH parsed AS ({PARSED_SQL}),
    numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS document_index FROM parsed),
    good AS (SELECT * FROM parsed WHERE success)
    SELECT n.document_index, c.doc_id, c.chunk_id, c.total_chunks
    FROM ({windows_sql(1000, 200, "good")}) c JOIN numbered n USING (doc_id)""")
def chunk_document_index(spark, d):
    """Chunks of many documents with the position of their document, failed ones counted."""
    return chunking.chunk_documents(_parsed(spark, d), "doc_id", separators=[""]).select(
        "document_index", "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
    )


@query("filter_failed", f"SELECT doc_id FROM ({PARSED_SQL}) WHERE success")
def filter_failed(spark, d):
    return _parsed(spark, d).filter("success").select("doc_id")


@query("filter_blank", f"""
    SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN chr(160) || chr(9) ELSE text END AS t
    FROM conversations) WHERE {strip_sql("t")} <> ''""")
def filter_blank(spark, d):
    """Turns that still have text after every third one is blanked."""
    blanked = F.when(F.col("turn") % 3 == 1, "\xa0\t").otherwise(F.col("text"))
    return read_table(spark, d, "conversations").filter(~is_blank(blanked)).select("conv_id", "turn")
