"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes (all of them).  Each passage is described by its bytes:
shares of byte classes and of hashed byte pairs, and how much of it repeats at a short distance.  A small layer
encodes the description; gated attention weighs the encoded passages of a document against each other; the
weighted sum is what the classifier sees.  Labels are known for documents only, and the attention is learned
from them by gradient descent, together with the encoder and the classifier.

Learning uses at most ``TRAIN_DOCS`` distinct labelled texts, drawn by a hash of the text; of a text longer than
``TRAIN_PASSAGES`` passages it sees that many, evenly spaced.  Scoring always sees whole texts.

Nulls: null and empty texts are one empty passage and get its score.  Repeated rows give repeated rows.  Without
labels every score is 0.5; with one class only, the share of that class.  Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, documents, labelled_sample, remainder
from corpusmill.llm.registry import query
from corpusmill.llm.training import Adam, sigmoid
from corpusmill.session import read_table

TRAIN_DOCS = 3000
TRAIN_PASSAGES = 24
PASSAGE = 512
PAIRS = 64
LAGS = range(2, 25)
ENCODED, ATTENTION = 24, 12
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    """Class of each byte: the 33 signs of ASCII apart, then groups."""
    kind = np.full(256, 5)
    kind[:128] = [0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if b in (9, 10, 13) else 4 for b in range(128)]
    signs = [b for b in range(32, 127) if not chr(b).isalnum()]
    kind[signs] = np.arange(6, 6 + len(signs))
    return kind


_KIND = _classes()
_KINDS = int(_KIND.max()) + 1
FEATURES = _KINDS + PAIRS + 3


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(descriptions, document of each passage)`` of all passages of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), counts)
    n = int(counts.sum())
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(texts), np.uint8)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(first, sizes) + within // PASSAGE
    length = np.maximum(1, np.bincount(row, minlength=n)).astype(np.float64)
    kinds = np.bincount(row * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS) / length[:, None]
    pair = (data[:-1].astype(np.int64) * 31 + data[1:]) % PAIRS
    pairs = np.bincount(row[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / length[:, None]
    most = np.zeros(n)
    for lag in LAGS:
        if len(data) > lag:
            same = (data[lag:] == data[:-lag]) & (row[lag:] == row[:-lag])
            most = np.maximum(most, np.bincount(row[lag:][same], minlength=n) / length)
    used = (pairs > 0).mean(axis=1)
    return np.column_stack([kinds, pairs, most, used, np.log1p(length) / 6]).astype(np.float32), owner


def train(rows: list[tuple[bytes, int]], rounds: int = 14, batch: int = 48, seed: int = 3):
    """Weights of the model; a constant where there is nothing to learn from."""
    y = np.array([int(v) for _, v in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    x, owner = describe([t for t, _ in rows])
    bags = []
    for i, bag in enumerate(np.split(np.arange(len(owner)), np.searchsorted(owner, np.arange(1, len(rows))))):
        bags.append(bag if len(bag) <= TRAIN_PASSAGES else bag[np.linspace(0, len(bag) - 1, TRAIN_PASSAGES).astype(int)])
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / spread, -6, 6).astype(np.float64)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    w = {"w": draw(FEATURES, ENCODED), "b": np.zeros(ENCODED), "v": draw(ENCODED, ATTENTION), "u": draw(ENCODED, ATTENTION),
         "a": draw(ATTENTION) * 0.1, "c": draw(ENCODED), "d": np.zeros(1)}
    adam = Adam(w, 0.01)
    for r in range(rounds):
        adam.rate = 0.01 if r < rounds * 2 // 3 else 0.002
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            rows_at = np.concatenate([bags[i] for i in part])
            bag = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            adam.step(_gradients(w, x[rows_at], bag, y[part]))
    return {k: v.astype(np.float32) for k, v in w.items()} | {"mean": mean, "spread": spread}


def _attend(w, x: np.ndarray, bag: np.ndarray, count: int):
    """Encoded passages, attention within each bag, weighted sums."""
    h = np.tanh(x @ w["w"] + w["b"])
    t, s = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
    e = (t * s) @ w["a"]
    top = np.full(count, -np.inf)
    np.maximum.at(top, bag, e)
    e = np.exp(e - top[bag])
    a = e / np.bincount(bag, e, count)[bag]
    z = np.zeros((count, h.shape[1]))
    np.add.at(z, bag, a[:, None] * h)
    return h, t, s, a, z


def _gradients(w, x, bag, y):
    n = len(y)
    h, t, s, a, z = _attend(w, x, bag, n)
    p = sigmoid(z @ w["c"] + w["d"])
    d = (p - y) / n
    dz = np.outer(d, w["c"])
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.bincount(bag, a * da, n)[bag])
    dt, ds = de[:, None] * w["a"] * s * (1 - t * t), de[:, None] * w["a"] * t * s * (1 - s)
    dh = a[:, None] * dz[bag] + dt @ w["v"].T + ds @ w["u"].T
    dg = dh * (1 - h * h)
    decay = 1e-4
    return {"w": x.T @ dg + decay * w["w"], "b": dg.sum(0), "v": h.T @ dt + decay * w["v"], "u": h.T @ ds + decay * w["u"],
            "a": (de[:, None] * t * s).sum(0), "c": z.T @ d + decay * w["c"], "d": np.array([d.sum()])}


def score(model, texts: list[bytes | None]) -> list[float]:
    if "constant" in model:
        return [model["constant"]] * len(texts)
    x, owner = describe([t or b"" for t in texts])
    x = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    z = _attend(model, x, owner, len(texts))[-1]
    return sigmoid(z @ model["c"] + model["d"]).astype(float).tolist()


def with_score(df: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of ``text``."""
    return annotate(df, text, [(name, T.DoubleType())], lambda: lambda texts: [score(model, texts)])


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str):
    learn = docs.where(remainder(F.col("doc_id"), 4) != 2)
    return train(labelled_sample(learn, read_table(spark, sf_dir, "labels"), "quality", TRAIN_DOCS))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = with_score(docs, fitted(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
