"""Text to unit vectors.

The default encoder needs no download: word counts in signed buckets drawn from MD5 digests, weighted by inverse
document frequency, unit length.  Nothing of it depends on a library's hash, so SQL can say the same.  Any other
model plugs in through :func:`model_encoder`.
"""

from __future__ import annotations

import hashlib
import json
import math
import string
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import hadoop_files

# --- fixed values -----------------------------------------------------------------------------
EMBEDDING_DIM = 384
ENCODE_BATCH = 32
# ----------------------------------------------------------------------------------------------

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MEMO_WORDS = 200_000
MEMO_LENGTH = 64


class _Memo(dict):
    """Places of the words in a run of text without white space; long runs are not remembered."""

    def __init__(self, dimension: int):
        self.dimension = dimension
        self.packed = [i.to_bytes(4, sys.byteorder) for i in range(2 * dimension)]

    def __missing__(self, run: str) -> bytes:
        core = run.strip(string.punctuation)
        if core.isalnum() and core.isascii():  # one word, as nearly always
            places = self._draw(core.lower())
        elif core.isalpha():
            places = self._draw(core.translate(_LOWER))
        else:
            places = b"".join([self._draw(w) for w in _WORD.findall(run.translate(_LOWER))])
        if len(run) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[run] = places
        return places

    def _draw(self, word: str) -> bytes:
        """Bucket of a word, by the first 32 bits of its digest; the half byte after them tells its sign, minus behind all plus."""
        digest = hashlib.md5(word.encode("utf-8", "replace")).digest()
        return self.packed[int.from_bytes(digest[:4], "big") % self.dimension + (0 if digest[4] < 128 else self.dimension)]


class _Counter:
    """Word counts of texts in signed buckets, with a bounded memo."""

    def __init__(self, dimension: int):
        self.dimension, self.memo = dimension, _Memo(dimension)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """How many words of ``text`` count up and how many count down in each bucket."""
        places = b"".join(map(self.memo.__getitem__, (text or "").split()))
        both = np.bincount(np.frombuffer(places, np.int32), minlength=2 * self.dimension)
        return both[:self.dimension], both[self.dimension:]


class HashingEncoder:
    """Default encoder; fitted once on the chunks and used for chunks and queries alike."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "text", dimension: int = EMBEDDING_DIM) -> HashingEncoder:
        """Weights from the number of texts that have a word in each bucket; a row per bucket reaches the driver."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter, met, rows = _Counter(dimension), np.zeros(dimension, np.int64), 0
            for batch in batches:
                rows += batch.num_rows
                for value in batch.column(0):
                    up, down = counter(value.as_py())
                    met += (up + down) > 0
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dimension)], pa.int32()), pa.array([rows, *met.tolist()], pa.int64())], ["bucket", "met"])

        counts = dict(texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, met long").groupBy("bucket").agg(F.sum("met")).collect())
        n = counts.get(-1, 0)
        return cls([math.log((n + 1) / (counts.get(i, 0) + 1)) for i in range(dimension)])

    def encode(self, texts: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """``texts`` with a unit vector; a text without words that tell anything has the zero vector."""
        weights = np.array(self.weights)

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counter = _Counter(len(weights))
            for batch in batches:
                rows = np.empty((len(batch), len(weights)), np.float32)
                for i, value in enumerate(batch):
                    up, down = counter(value.as_py())
                    row = (up - down) * weights
                    length = math.sqrt(float(row @ row))
                    rows[i] = row / length if length else row
                yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(weights), rows.reshape(-1))

        return texts.withColumn(out, vectors(F.col(text).cast("string")))

    def save(self, spark: SparkSession, path: str) -> None:
        """Written beside its place and renamed, so a reader never meets half of it."""
        files, make = hadoop_files(spark, path)
        stream = files.create(make(f"{path}.part"))
        stream.write(json.dumps(self.weights).encode())
        stream.close()
        files.delete(make(path), True)
        if not files.rename(make(f"{path}.part"), make(path)):
            raise OSError(f"cannot write {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashingEncoder:
        files, make = hadoop_files(spark, path)
        stream = files.open(make(path))
        try:
            return cls(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()


def encoded_sql(rows: str, keys: str, text: str, fitted: str, dimension: int = EMBEDDING_DIM) -> str:
    """The same vectors in SQL: ``keys, embedding FLOAT[]`` of a relation, with weights of ``fitted(text)``."""
    drawn = """SELECT {keys}, (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INT AS b, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
               FROM (SELECT {keys}, unnest(regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}]+')) AS w
                     FROM {rows})"""
    return f"""
        SELECT {keys}, list_transform(v, lambda x: (CASE WHEN n > 0 THEN x / n ELSE x END)::FLOAT) AS embedding
        FROM (SELECT {keys}, v, sqrt(list_inner_product(v, v)) AS n FROM (
            SELECT {keys}, list(coalesce(c, 0.0)::DOUBLE * weight ORDER BY b) AS v
            FROM {rows} CROSS JOIN (
                SELECT b, ln((total + 1) / (coalesce(met, 0) + 1)::DOUBLE) AS weight
                FROM (SELECT count(*) AS total FROM {fitted}) CROSS JOIN (SELECT unnest(range({dimension}))::INT AS b)
                LEFT JOIN (SELECT b, count(DISTINCT id) AS met FROM ({drawn.format(keys="id", dim=dimension, text="text", rows=f"(SELECT row_number() OVER () AS id, text FROM {fitted})")}) GROUP BY b) USING (b))
            LEFT JOIN (SELECT {keys}, b, sum(s) AS c FROM ({drawn.format(keys=keys, dim=dimension, text=text, rows=rows)}) GROUP BY ALL) USING ({keys}, b)
            GROUP BY {keys}))"""


def model_encoder(
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: Column,
    normalize: bool = True,
    batch_size: int = ENCODE_BATCH,
) -> Column:
    """Vectors of a user model, loaded once per Python worker and fed in batches.

    A zero vector has no direction and stays as it is.
    """

    def make():
        predict = make_predict()

        def unit_rows(batch: np.ndarray) -> np.ndarray:
            vectors = np.asarray(predict(batch), dtype=np.float64)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            return np.divide(vectors, length, out=vectors, where=length > 0).astype(np.float32)

        return unit_rows if normalize else predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)(text)
