import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("text_key", T.StringType()),
])


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, "a", "b", "c", "d", "e")


def prose(seed, words=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    same = prose(1)
    return [
        row(None, None), row(None, "a b"), row(1, None), row(2, ""), row(3, " \n\t "), row(4, same), row(4, same), row(5, same), row(6, same + " x"),
        row(7, prose(7, 30_000)), row(8, "é" * 5000), row(9, "\x00\x1c  ~0 <s>"), row(10, "under the mit license. Under the MIT License", None),
        row(11, "You are an idiot. a moron! stupid loser", "fr"), row(-5, prose(3)), row(12, prose(3) + " tail"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
