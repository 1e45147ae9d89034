"""Streaming runs over the given tables; each equals its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.plans.catalog.chunks import windows_sql
from corpusmill.plans.catalog.registry import TWINS, query
from corpusmill.session import hadoop_files, read_table, scratch_dir
from corpusmill.streaming import incremental


def _stream(spark, d, table):
    """A table as a stream, be it one file or a folder of them."""
    path, source = f"{d}/{table}.parquet", spark.readStream.schema(read_table(spark, d, table).schema)
    files, make = hadoop_files(spark, path)
    if files.getFileStatus(make(path)).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(d)


@query("stream_usage", TWINS["usage_by_model"])
def stream_usage(spark, d):
    counters = incremental.usage_stream(_stream(spark, d, "events"), F.col("event_type"), F.floor("value"))
    return incremental.latest_state(counters, "usage")


@query("stream_usage_once", TWINS["usage_by_model"])
def stream_usage_once(spark, d):
    """Every request arrives twice and counts once."""
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    log = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_copy", twice)
    counters = incremental.usage_stream(log, F.col("event_type"), F.floor("value"), "event_id", "ts", "400 days")
    return incremental.latest_state(counters, "usage-once")


@query("stream_chunks", f"SELECT doc_id, chunk_id, length(text) AS chunk_size, text FROM ({windows_sql(1000, 200)})")
def stream_chunks(spark, d):
    """Documents chunked as they arrive and appended to a table."""
    docs = _stream(spark, d, "documents").select("doc_id", "text", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    chunks = incremental.stream_chunks(docs, separators=[""])
    out = scratch_dir(spark, "stream-chunks")
    incremental.append_stream(chunks, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(chunks.schema).parquet(f"{out}/rows").select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("chunk_size").cast("bigint").alias("chunk_size"), "text"
    )


_STATES_SQL = """
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN 'cannot read' END AS error FROM documents"""


@query("stream_file_status", f"""
    SELECT d.doc_id::VARCHAR AS doc_key, count(c.chunk_id) > 0 AS success, count(c.chunk_id) AS n_chunks, count(c.chunk_id) AS stored_chunks,
           coalesce(any_value(d.error), CASE WHEN count(c.chunk_id) = 0 THEN 'No text content found' END) AS error
    FROM ({_STATES_SQL}) d LEFT JOIN ({windows_sql(1000, 200, f"({_STATES_SQL})")}) c USING (doc_id) GROUP BY d.doc_id""")
def stream_file_status(spark, d):
    """Documents as they arrive, every seventh unreadable: the state of each, and the chunks that were stored for it."""
    failed = F.col("doc_id") % 7 == 0
    docs = _stream(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_key"), F.lit(None).cast("string").alias("filename"), F.when(failed, "").otherwise(F.col("text")).alias("text"),
        (~failed).alias("success"), F.when(failed, "cannot read").alias("error"))
    out = incremental.StreamedDocuments(spark, scratch_dir(spark, "stream-documents"))
    out.write(docs, separators=[""]).awaitTermination()
    stored = out.chunks().groupBy("doc_key").agg(F.count(F.lit(1)).alias("stored_chunks"))
    return out.status().join(stored, "doc_key", "left").select(
        "doc_key", "success", "n_chunks", F.coalesce("stored_chunks", F.lit(0).cast("long")).alias("stored_chunks"), "error")


@query("stream_usage_reset", TWINS["usage_since_reset"])
def stream_usage_reset(spark, d):
    """Usage counters that a reset event of every model clears, somewhere among its requests."""
    events = read_table(spark, d, "events")
    models = F.array(*[F.lit(r[0]) for r in events.select("event_type").distinct().collect()])  # a handful of models
    at = F.lit("2024-01-10 00:00:00").cast(events.schema["ts"].dataType)
    log = _stream(spark, d, "events").select("event_type", "ts", "value", F.lit(False).alias("is_reset"), "event_id")
    # the first event brings a reset of every model with it
    resets = F.when(F.col("event_id") == 0, F.transform(models, lambda m: F.struct(m.alias("event_type"), at.alias("ts"), F.lit(0.0).alias("value"), F.lit(True).alias("is_reset"))))
    own = F.array(F.struct("event_type", "ts", "value", "is_reset"))
    rows = log.select(F.explode(F.concat(own, F.coalesce(resets, F.slice(own, 1, 0)))).alias("r")).select("r.*")
    counters = incremental.usage_stream_with_resets(rows, F.col("event_type"), F.floor("value"), F.col("ts"), F.col("is_reset"))
    return incremental.latest_update(counters, "model", "usage-reset").where("total_requests > 0")
