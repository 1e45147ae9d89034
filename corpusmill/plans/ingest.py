"""Folder or table of texts -> chunks with vectors -> knowledge base."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.encoders import HashingEncoder
from corpusmill.functions.text import suffix
from corpusmill.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_table, recursive_chunks
from corpusmill.session import materialize
from corpusmill.sources.files import Extractor, merge_metadata, parse_files, scan_files, supported_extensions
from corpusmill.sources.knowledge_base import KnowledgeBase

FILE_RESULT = "file_name string, success boolean, chunks_added bigint, error string"
NO_TEXT = "No text content found"


class Ingested(NamedTuple):
    """Per-file results stay a table; only the totals are one row.  Queries need ``encoder``."""

    results: DataFrame
    summary: DataFrame
    error: str | None = None
    encoder: HashingEncoder | None = None


def chunked(
    parsed: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None
) -> DataFrame:
    """Parsed documents with their chunk array, in the final state of each file."""
    chunks = recursive_chunks(F.when(F.col("success"), F.col("text")), size, overlap, separators)
    rows = parsed.withColumn("chunks", F.coalesce(chunks, F.array().cast("array<string>"))).drop("text")
    empty = F.col("success") & (F.size("chunks") == 0)
    return rows.withColumn("error", F.when(empty, F.lit(NO_TEXT)).otherwise(F.col("error"))).withColumn(
        "success", F.col("success") & (F.size("chunks") > 0)
    )


def chunk_rows(documents: DataFrame) -> DataFrame:
    """Chunk rows of documents that carry a chunk array."""
    rest = [c for c in documents.columns if c not in ("chunks", "success", "error")]
    return chunk_table(documents.filter("success").select(*rest, F.lit("").alias("text"), "chunks"), F.col("chunks")).drop("chunks")


def file_results(documents: DataFrame, name: Column, added: Column | None = None) -> DataFrame:
    """One row per file; ``added`` is the number of chunks stored, else all it has count."""
    number = F.size("chunks") if added is None else added
    return documents.select(name.alias("file_name"), "success", number.cast("bigint").alias("chunks_added"), "error")


def ingest_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("chunks_added"))), F.lit(0)).cast("bigint").alias("total_chunks"),
    )


def ingest_documents(parsed: DataFrame, kb: KnowledgeBase, encoder: HashingEncoder | None = None, mode: str = "idempotent",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> Ingested:
    """Chunk, encode and store documents (``doc_key, filename, source, text, success, error``).

    The chunked documents are written once to shared scratch: fitting the encoder, storing and
    reporting all read them, and the text is parsed and cut only once.
    """
    for missing in {"filename", "source", "error"} - set(parsed.columns):
        parsed = parsed.withColumn(missing, F.lit(None).cast("string"))
    documents = materialize(chunked(parsed, size, overlap, separators), "chunked")
    chunks = chunk_rows(documents)
    fitted = encoder or kb.encoder(lambda: HashingEncoder.fit(chunks, dimension=kb.dimension))
    # a document that holds no text any more loses its chunks; one that could not be read keeps them
    blank = documents.where(~F.col("success") & (F.col("error") == NO_TEXT)).select("doc_key")
    added = kb.add(fitted.encode(chunks), mode, removed=blank)
    reported = documents.join(added, "doc_key", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    results = materialize(file_results(reported, F.coalesce("filename", "source"), F.col("added")), "results")
    return Ingested(results, ingest_summary(results), encoder=fitted)


def ingest_directory(
    spark: SparkSession, directory: str, kb: KnowledgeBase, recursive: bool = True,
    extensions: list[str] | None = None, extractors: dict[str, Extractor] | None = None,
    extra: dict[str, str] | None = None, encoder: HashingEncoder | None = None, mode: str = "idempotent",
) -> Ingested:
    """Every supported file of a folder; a missing folder gives a zero summary with an error."""
    try:
        wanted = extensions or supported_extensions(extractors)
        files = scan_files(spark, directory, recursive, wanted)
    except FileNotFoundError as problem:
        nothing = spark.createDataFrame([], FILE_RESULT)
        return Ingested(nothing, ingest_summary(nothing), str(problem))
    pairs = [F.lit(x) for item in (extra or {}).items() for x in item]
    facts = F.create_map(
        F.lit("file_size_bytes"), F.col("length").cast("string"), F.lit("extension"), suffix(F.col("path")),
        F.lit("modified"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = parse_files(files, extractors).select(
        F.col("path").alias("doc_key"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit((extra or {}).get("source")).cast("string").alias("source"),
        merge_metadata(facts, F.create_map(*pairs).cast("map<string,string>")).alias("extra"), "text", "success", "error",
    )
    return ingest_documents(parsed, kb, encoder, mode)
