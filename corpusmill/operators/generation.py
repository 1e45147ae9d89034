"""Model calls over a prompt table, and usage accounting."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.session import hadoop_files, materialize

# --- fixed values -----------------------------------------------------------------------------
MAX_ATTEMPTS, FIRST_DELAY = 3, 1.0
# ----------------------------------------------------------------------------------------------

STORED = "prompt_key string, response string, tokens long"
Call = Callable[[str, str], tuple[str, int]]


def prompt_key(system: Column, user: Column) -> Column:
    """Key under which a response can be stored and found again."""
    return F.sha2(F.to_json(F.array(system, user)), 256)


def generate(
    prompts: DataFrame,
    make_call: Callable[[], Call],
    request_id: str = "query_id",
    attempts: int = MAX_ATTEMPTS,
    delay: float = FIRST_DELAY,
) -> DataFrame:
    """Call a model once per row: ``<id>, prompt_key, response, error, attempts, tokens``.

    ``make_call`` runs once per task and returns ``call(system, user) -> (response, tokens)``.  A
    failing call is repeated with a doubling delay; its last error becomes a column, so one bad
    request never fails the job.  A task that is run again calls again: write the result (for
    example with :func:`corpusmill.session.materialize`) before parsing it.
    """
    schema = T.StructType([
        prompts.schema[request_id],
        T.StructField("prompt_key", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("tokens", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def ask(call: Call, system: str, user: str) -> dict:
        wait, problem = delay, None
        for attempt in range(1, attempts + 1):
            try:
                response, tokens = call(system, user)
                return {"response": response, "error": None, "attempts": attempt, "tokens": tokens}
            except Exception as failure:  # any failure of the user's model is a row-level error
                problem = str(failure)
            if attempt < attempts:
                time.sleep(wait)
                wait *= 2
        return {"response": None, "error": problem, "attempts": attempts, "tokens": 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_call()
        for batch in batches:
            rows = [
                {request_id: r[request_id], "prompt_key": r["prompt_key"], **ask(call, r["system"], r["user"])}
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    keyed = prompts.select(request_id, prompt_key(F.col("system"), F.col("user")).alias("prompt_key"), "system", "user")
    return keyed.mapInArrow(run, schema)


class ResponseStore:
    """Successful responses by prompt key, in a folder every executor can reach; only ever appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        """``(prompt_key, response, tokens)``, one row per key whatever runs have written."""
        files, make = hadoop_files(self.spark, self.path)
        if not files.exists(make(self.path)):
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(self.path)
        return rows.groupBy("prompt_key").agg(F.min(F.struct("response", "tokens")).alias("_first")).select("prompt_key", "_first.response", "_first.tokens")

    def generate(self, prompts: DataFrame, make_call: Callable[[], Call], request_id: str = "query_id",
                 attempts: int = MAX_ATTEMPTS, delay: float = FIRST_DELAY) -> DataFrame:
        """As :func:`generate`, with ``from_store``: what the store knows is not asked again, equal prompts are asked once.

        Of equal prompts the row of the smallest id carries the attempts of the call, the others 0; stored answers
        count 0 attempts and 0 tokens.  New answers are written before anything reads them, so a run that is
        repeated finds them; failures are not stored and are asked again by the next run.
        """
        keyed = prompts.select(request_id, "system", "user", prompt_key(F.col("system"), F.col("user")).alias("prompt_key"))
        keyed = materialize(keyed, "prompts")
        known = materialize(self.load().join(keyed.select("prompt_key").distinct(), "prompt_key", "left_semi"), "known")
        first = F.min(F.struct(request_id, "system", "user")).alias("_one")
        open_ = keyed.join(known.select("prompt_key"), "prompt_key", "left_anti").groupBy("prompt_key").agg(first).select("_one.*")
        called = materialize(generate(open_, make_call, request_id, attempts, delay), "called")
        called.where(F.col("response").isNotNull()).select("prompt_key", "response", "tokens").write.mode("append").parquet(self.path)
        asked = called.select("prompt_key", F.col(request_id).alias("_asked"), F.col("response").alias("_new"), "error", "attempts", F.col("tokens").alias("_spent"))
        stored = known.select("prompt_key", F.col("response").alias("_old"), F.lit(True).alias("_stored"))
        own = F.col("_asked").eqNullSafe(F.col(request_id))
        return keyed.join(stored, "prompt_key", "left").join(asked, "prompt_key", "left").select(
            request_id, "prompt_key", F.coalesce("_old", "_new").alias("response"), "error",
            F.when(own, F.col("attempts")).otherwise(0).alias("attempts"), F.when(own, F.col("_spent")).otherwise(F.lit(0)).cast("long").alias("tokens"),
            F.coalesce("_stored", F.lit(False)).alias("from_store"))


def usage_stats(log: DataFrame, model: Column, tokens: Column, since: Column | None = None) -> DataFrame:
    """Requests and tokens per model; ``since`` (a condition) counts from the last reset on."""
    counted = log if since is None else log.filter(since)
    return counted.groupBy(model.alias("model")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens_used"),
    )
