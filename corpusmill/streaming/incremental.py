"""Incremental runs of the batch jobs; each gives the batch result once all input has arrived."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions.encoders import HashingEncoder
from corpusmill.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_table, recursive_chunks
from corpusmill.operators.generation import usage_stats
from corpusmill.plans.ingest import chunk_rows, chunked
from corpusmill.session import materialize, scratch_dir
from corpusmill.sources.files import FILES_TYPE, name_pattern, parse_files, supported_extensions
from corpusmill.sources.knowledge_base import KnowledgeBase

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, directory: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """New files of a folder as a stream (``path, modificationTime, length, content``).

    As in the batch scan, files of other kinds are skipped while listing.
    """
    wanted = supported_extensions() if extensions is None else extensions
    return (
        spark.readStream.format("binaryFile").schema(FILES_TYPE).option("pathGlobFilter", name_pattern(wanted))
        .option("recursiveFileLookup", str(recursive).lower()).load(directory)
    )


def documents_of(files: DataFrame) -> DataFrame:
    return parse_files(files).select(
        F.col("path").alias("doc_key"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("source"), "text", "success", "error",
    )


def stream_chunks(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None
) -> DataFrame:
    """Chunks of a document stream; stateless, so any trigger and any batch size give the same rows."""
    good = documents.filter("success").drop("success", "error")
    return chunk_table(good, recursive_chunks(F.col("text"), size, overlap, separators))


def ingest_stream(chunks: DataFrame, kb: KnowledgeBase, encoder: HashingEncoder, checkpoint: str) -> StreamingQuery:
    """Store every chunk that has arrived, then stop.

    A micro-batch that is replayed after a failure is added idempotently, so nothing doubles.
    """

    def store(batch: DataFrame, _batch_id: int) -> None:
        kb.add(encoder.encode(batch), "idempotent")

    return chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder exactly once, then stop."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


class StreamedDocuments:
    """Chunks and file states of a document stream, each exactly once, in one folder.

    A micro-batch writes its chunks and then its file states, each into the directory of its batch number and over
    whatever an interrupted attempt left there.  The states are the record that a batch is complete: chunks of a
    batch without them are not shown.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> StreamingQuery:
        """Cut and store every document that has arrived (``doc_key, filename, text, success, error``), then stop."""
        cut = chunked(documents, size, overlap, separators)

        def store(batch: DataFrame, number: int) -> None:
            held = materialize(batch, "batch")  # parsed and cut once for both outputs
            chunk_rows(held).write.mode("overwrite").parquet(f"{self.path}/chunks/batch={number}")
            states = held.select("doc_key", "filename", "success", "error", F.size("chunks").cast("long").alias("n_chunks"))
            states.write.mode("overwrite").parquet(f"{self.path}/status/batch={number}")

        return cut.writeStream.foreachBatch(store).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def status(self) -> DataFrame:
        """A row per file, failed ones included."""
        return self._read("status").drop("batch")

    def chunks(self) -> DataFrame:
        complete = self._read("status").select("batch").distinct()
        return self._read("chunks").join(F.broadcast(complete), "batch", "left_semi").drop("batch")  # a row per batch


class _Counters(StatefulProcessor):
    """Requests and tokens per minute since the last reset of a model."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reset = handle.getValueState("reset", "at long")
        self.minutes = handle.getMapState("minutes", "minute long", "requests long, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start = self.reset.get()[0] if self.reset.exists() else -(1 << 62)
        for frame in rows:
            resets = frame.loc[frame["is_reset"], "minute"]
            if len(resets) and int(resets.max()) > start:
                start = int(resets.max())
                self.reset.update((start,))
                for old in [k for k in self.minutes.keys() if k[0] < start]:
                    self.minutes.removeKey(old)
            counted = frame.loc[~frame["is_reset"] & (frame["minute"] >= start)]
            for minute, group in counted.groupby("minute"):
                at = (int(minute),)
                requests, tokens = self.minutes.getValue(at) if self.minutes.containsKey(at) else (0, 0)
                self.minutes.updateValue(at, (requests + len(group), tokens + int(group["tokens"].fillna(0).sum())))
        found = list(self.minutes.values())
        yield pd.DataFrame({"model": [key[0]], "total_requests": [sum(v[0] for v in found)], "total_tokens_used": [sum(v[1] for v in found)]})

    def close(self) -> None:
        pass


def usage_stream_with_resets(log: DataFrame, model: Column, tokens: Column, event_time: Column, is_reset: Column) -> DataFrame:
    """Running usage per model; a reset event of a model clears what came before its minute.

    Order of arrival does not matter: requests before the last reset are not counted, however late they come, and a
    late reset keeps the minutes from it on.  State is one counter per model and minute since its last reset.
    """
    rows = log.select(model.alias("model"), tokens.cast("long").alias("tokens"), F.floor(event_time.cast("timestamp").cast("double") / 60).cast("long").alias("minute"),
                      F.coalesce(is_reset, F.lit(False)).alias("is_reset"))
    return rows.groupBy("model").transformWithStateInPandas(
        statefulProcessor=_Counters(), outputStructType="model string, total_requests long, total_tokens_used long", outputMode="Update", timeMode="None")


def latest_update(counters: DataFrame, key: str, purpose: str) -> DataFrame:
    """Run an update-mode stream over all input; of every key the row of its last batch."""
    spark, out = counters.sparkSession, scratch_dir(counters.sparkSession, purpose)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    with_state = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    before = {k: spark.conf.get(k, None) for k in with_state}
    for k, v in with_state.items():
        spark.conf.set(k, v)  # the state of this kind of operator needs this store
    try:
        (
            counters.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = T.StructType([*counters.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(shape).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    rest = [c for c in counters.columns if c != key]
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def usage_stream(
    log: DataFrame, model: Column, tokens: Column, request_id: str | None = None,
    event_time: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Running usage per model; with a request id and a time, repeated requests count once."""
    if request_id and event_time:
        log = log.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([request_id])
    return usage_stats(log, model, tokens)


def latest_state(counters: DataFrame, purpose: str) -> DataFrame:
    """Run a complete-mode aggregate over all input and return its last state."""
    spark = counters.sparkSession
    out = scratch_dir(spark, purpose)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    (
        counters.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{out}/state")
