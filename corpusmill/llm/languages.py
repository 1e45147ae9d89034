"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut at white space into runs of at most ``RUN`` bytes.  Two gated recurrent layers read a run's bytes
forwards and backwards, a linear layer labels every position with a probability per language, and the document's
probability is the mean over all positions of the whole text.  The network is trained here by backpropagation
through time, on runs of at most ``TRAIN_DOCS`` distinct labelled texts that are drawn by a hash of the text.

Equal runs have equal labels, so a worker runs the network once per different run it meets and remembers the sums.

Nulls: texts that are null or hold no letter are ``und`` with score 0.  Rows without a language are never learned
from.  Without any labelled row every text is ``und``.  Very long texts are one row and read whole.  Of languages that
tie the first by name is taken.  Repeated rows give repeated rows; empty tables give an empty result.  Columns named
``lang_pred`` or ``score`` are replaced, other columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, labelled_sample, once, remainder
from corpusmill.llm.registry import query
from corpusmill.llm.training import Adam
from corpusmill.session import read_table

TRAIN_DOCS = 2000
#: Longest run of bytes that is read at once.
RUN = 24
HIDDEN, EMBEDDING = 16, 12
STEPS, BATCH = 700, 256
MEMO = 600_000


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; digits in circles, fractions and Roman numerals are not."""
    return any(map(str.isalpha, text))


def runs_of(text: bytes) -> list[bytes]:
    """The whole text: what white space separates, long stretches in pieces."""
    runs = text.split()
    if runs and max(map(len, runs)) > RUN:
        runs = [r[i:i + RUN] for r in runs for i in range(0, len(r), RUN)]
    return runs


def padded(runs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the runs at the left, and which positions are used."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in runs), np.uint8).reshape(len(runs), width)
    return data, np.arange(width) < sizes[:, None]


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, classes: int, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"e": draw(256, EMBEDDING) * 8, "o": draw(2 * HIDDEN, classes), "ob": np.zeros(classes, np.float32)}
        for way in "fb":
            w |= {f"x{way}": draw(EMBEDDING, 3 * HIDDEN), f"h{way}": draw(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(w)

    def read(self, way: str, data: np.ndarray, used: np.ndarray, keep: bool):
        """States after every byte of one direction; unused positions leave the state as it is."""
        n, width = data.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((width, n, HIDDEN), np.float32)
        tape = {}
        table = self.w["e"] @ self.w[f"x{way}"] + self.w[f"b{way}"]  # what each byte adds to the gates
        for t in range(width) if way == "f" else range(width - 1, -1, -1):
            x = table[data[:, t]]
            r = h @ self.w[f"h{way}"]
            z = 1 / (1 + np.exp(-(x[:, :HIDDEN] + r[:, :HIDDEN])))
            g = 1 / (1 + np.exp(-(x[:, HIDDEN:2 * HIDDEN] + r[:, HIDDEN:2 * HIDDEN])))
            c = np.tanh(x[:, 2 * HIDDEN:] + g * r[:, 2 * HIDDEN:])
            new = np.where(used[:, t, None], z * h + (1 - z) * c, h)
            if keep:
                tape[t] = (h, z, g, c, r[:, 2 * HIDDEN:])
            states[t] = h = new
        return states, tape

    def label(self, data: np.ndarray, used: np.ndarray, keep: bool = False):
        """Probabilities ``[position, run, language]``."""
        forward, tape_f = self.read("f", data, used, keep)
        backward, tape_b = self.read("b", data, used, keep)
        both = np.concatenate([forward, backward], axis=2)
        logits = both @ self.w["o"] + self.w["ob"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, both, tape_f, tape_b

    def gradients(self, data: np.ndarray, used: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, both, tape_f, tape_b = self.label(data, used, keep=True)
        count = used.sum()
        rows = np.arange(len(labels))
        loss = float((-np.log(p[:, rows, labels] + 1e-9) * used.T).sum() / count)
        d = p.copy()
        d[:, rows, labels] -= 1
        d *= (used.T / count)[:, :, None].astype(np.float32)
        grads = {"o": np.tensordot(both, d, ([0, 1], [0, 1])), "ob": d.sum((0, 1)), "e": np.zeros_like(self.w["e"])}
        d_both = d @ self.w["o"].T
        for way, tape, part in (("f", tape_f, d_both[:, :, :HIDDEN]), ("b", tape_b, d_both[:, :, HIDDEN:])):
            wx, wh = self.w[f"x{way}"], self.w[f"h{way}"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * HIDDEN, np.float32)
            ahead = np.zeros_like(part[0])
            width = data.shape[1]
            for t in range(width - 1, -1, -1) if way == "f" else range(width):
                h, z, g, c, rc = tape[t]
                ahead = ahead + part[t]
                on = used[:, t, None]
                live = np.where(on, ahead, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (h - c) * z * (1 - z)
                dg = dc * rc * g * (1 - g)
                dr = np.concatenate([dz, dg, dc * g], axis=1)
                dx = np.concatenate([dz, dg, dc], axis=1)
                embedded = self.w["e"][data[:, t]]
                gx += embedded.T @ dx
                gh += h.T @ dr
                gb += dx.sum(0)
                np.add.at(grads["e"], data[:, t], dx @ wx.T)
                ahead = np.where(on, live * z + dr @ wh.T, ahead)
            grads |= {f"x{way}": gx, f"h{way}": gh, f"b{way}": gb}
        return loss, grads


def train(rows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 7) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """``(languages, weights)``; None without rows.  Every language is drawn equally often."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    network = Network.fresh(len(languages))
    pools = [[r for t, y in rows if y == name for r in runs_of(t.lower())] for name in languages]
    pools = [p or [b"\0"] for p in pools]
    adam = Adam(network.w, 0.02)
    for step in range(steps):
        adam.rate = 0.02 if step < steps * 2 // 3 else 0.005
        labels = rng.integers(0, len(languages), BATCH)
        picked = [pools[k][int(rng.integers(len(pools[k])))] for k in labels]
        data, used = padded(picked, max(map(len, picked)))
        adam.step(network.gradients(data, used, labels)[1])
    return languages, network.w


class Reader:
    """A trained network and what it has said about runs so far."""

    def __init__(self, model):
        self.languages, weights = model
        self.network = Network(weights)
        self.memo: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        runs = [runs_of((t or b"").lower()) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.sums = self.sums[:0]
        new = sorted(set().union(*runs).difference(self.memo), key=len)
        parts = [self.sums]
        for s in range(0, len(new), 4096):
            part = new[s:s + 4096]
            data, used = padded(part, len(part[-1]))
            p = self.network.label(data, used)[0]
            parts.append((p * used.T[:, :, None]).sum(0).astype(np.float32))
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.sums = np.concatenate(parts)
        names, scores = [], []
        for text, own in zip(texts, runs, strict=True):
            if text is None or not has_letter(text.decode("utf-8", "replace")):
                names.append("und")
                scores.append(0.0)
                continue
            total = self.sums[np.fromiter(map(self.memo.__getitem__, own), np.int64, len(own))].sum(0, dtype=np.float64)
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(min(1.0, total[best] / total.sum())))
        return names, scores


def with_language(df: DataFrame, model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` of ``text``."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    mark = hash(tuple(w.tobytes() for w in model[1].values()))

    def maker():
        reader = once(("languages", mark), lambda: Reader(model))
        return lambda texts: reader.predict(texts)

    return annotate(df, text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], maker)


def fitted(docs: DataFrame):
    learn = docs.where(remainder(F.col("doc_id"), 5) != 0)
    return train(labelled_sample(learn.select("doc_id", "text"), learn.select("doc_id", "lang"), "lang", TRAIN_DOCS))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), fitted(docs)).drop("text")
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
