"""Near-duplicate vectors by spherical-cap filters.

The dimensions are cut into two halves, each with a random code of unit vectors; a filter direction is a pair
of code words, one per half, so ``CODE`` words per half name ``CODE**2`` directions.  A vector's product with
a direction is the sum of two products, so all directions it exceeds a threshold with are listed from two
sorted lists without looking at the rest (list decoding).  The threshold is the vector's own: the cap around it
that holds ``PASSED`` directions.  (One threshold for all lets vectors that lie badly to the code pass hardly
any filter; at equal cost it lost a quarter of the links at cosine 0.9.)  Vectors that share a filter are
compared in double precision; nothing below the wanted cosine is linked.  The chance to share none is what the
method can lose: under one percent at cosine 0.9 and next to nothing at 0.95 (tests measure it).

Equal vectors are one class before the join.  A filter with more than ``CELL`` classes is dealt to cells of
block pairs, so no filter has to fit one task; within a cell links are counted and followed, so pairs are never
written out.  A pair that shares several filters counts at the least of them only.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component.  Vectors of other length are never compared.  Rows with a null id take part.  Repeated
rows are different vectors that are linked.  Empty tables give an empty result; other columns are ignored.
Classes are named by a 64-bit hash of the vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import components, once
from corpusmill.llm.registry import query
from corpusmill.session import materialize, read_table

COSINE = 0.9
CODE = 1024
PASSED = 40
CELL = 2048
SEED = 17


def codes(dim: int, code: int = CODE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two halves' code words; structured by the dimension and seed only, so every task has the same."""
    def make():
        rng = np.random.default_rng([seed, dim, code])
        halves = []
        for size in (dim - dim // 2, dim // 2):
            words = rng.standard_normal((code, max(1, size)))
            halves.append((words / np.linalg.norm(words, axis=1, keepdims=True))[:, :size])
        return tuple(halves)

    return once(("codes", dim, code, seed), make)


def decode(unit: np.ndarray, code: int = CODE, passed: int = PASSED) -> list[np.ndarray]:
    """Sorted filter numbers of each row of ``unit`` (unit vectors of one length)."""
    first, second = codes(unit.shape[1], code)
    cut = first.shape[1]
    passed = min(passed, code)
    out = []
    for x, y in zip(unit[:, :cut] @ first.T, unit[:, cut:] @ second.T, strict=True):
        # no other word can be in the list, as each half's better words make as many better directions
        i, j = np.argpartition(-x, passed - 1)[:passed], np.argpartition(-y, passed - 1)[:passed]
        both = (x[i][:, None] + y[j]).ravel()
        best = np.argpartition(-both, passed - 1)[:passed]
        out.append(np.sort(i[best // passed] * code + j[best % passed]))
    return out


#: Vectors whose filter rows are in memory at once.
SLICE = 200


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list per row of a matrix, without a Python object per value."""
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def _filtered(code: int, passed: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                nodes, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                dims = np.array([len(v) for v in part.column(2)])
                for dim in np.unique(dims):
                    at = np.nonzero(dims == dim)[0]
                    x = np.stack([np.array(part.column(2)[i].as_py(), np.float64) for i in at.tolist()])
                    found = np.stack(decode(_units(x), code, passed))
                    times = found.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel() | int(dim) << 40, pa.int64()), pa.array(np.repeat(nodes[at], times), pa.int64()), pa.array(np.repeat(sizes[at], times), pa.int64()),
                         _lists(np.repeat(found, times, axis=0), pa.int32()), _lists(np.repeat(x, times, axis=0), kind)],
                        ["filter", "node", "size", "passed", "vector"])

    return run


def _shared_below(number: int, passed: list[list[int]]) -> np.ndarray:
    """Whether two rows share a filter below ``number``."""
    holders: dict[int, list[int]] = {}
    for i, row in enumerate(passed):
        for f in row:
            if f < number:
                holders.setdefault(f, []).append(i)
    shared = np.zeros((len(passed), len(passed)), bool)
    for rows in holders.values():
        if len(rows) > 1:
            shared[np.ix_(rows, rows)] = True
    return shared


def _linked(cosine: float):
    """Per cell and class: how many vectors it is linked with there, and the least class it hangs with."""

    def cell(rows):
        number = rows[0][0] & ((1 << 40) - 1)
        low, high, own = rows[0][5], rows[0][6], np.array([r[7] for r in rows])
        x = _units(np.stack([r[4] for r in rows]))
        links = x @ x.T >= cosine
        np.fill_diagonal(links, False)
        if low != high:
            links &= own[:, None] != own
        at = np.nonzero(links.any(axis=1))[0]
        if not len(at):
            return []
        links = links[np.ix_(at, at)]
        nodes = np.array([rows[i][1] for i in at])
        sizes = np.array([rows[i][2] for i in at])
        passed = [rows[i][3] for i in at]
        counted = np.where(links & ~_shared_below(number, passed), sizes, 0).sum(axis=1)
        least = nodes.copy()
        while True:
            new = np.minimum(least, np.where(links, least, np.iinfo(np.int64).max).min(axis=1))
            if (new == least).all():
                return list(zip(nodes.tolist(), counted.tolist(), least.tolist(), strict=True))
            least = new

    def run(batches):
        held: list = []
        out: list = []

        def flush():
            part = list(zip(*out, strict=True)) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], ["node", "links", "least"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # few rows at a time as Python objects
                columns = [batch.column(i).slice(start, 500) for i in range(8)]
                for row in zip(*[c if i == 4 else c.to_pylist() for i, c in enumerate(columns)], strict=True):
                    if held and (held[-1][0], held[-1][5], held[-1][6]) != (row[0], row[5], row[6]):
                        if len(held) > 1:
                            out.extend(cell(held))
                        held = []
                    held.append((*row[:4], np.array(row[4].as_py(), np.float64), *row[5:]))
            if len(out) > 10_000:
                yield flush()
        if len(held) > 1:
            out.extend(cell(held))
        yield flush()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, code: int = CODE,
                 passed: int = PASSED, cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id)`` per row of ``vectors``."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # then half the bytes carry it
    kind = "array<float>" if single else "array<double>"
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0)
    marked = plain.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.size("vector"), "vector")))
    good = marked.where(F.col("node").isNotNull())
    classes = materialize(good.groupBy("node").agg(F.count("*").alias("size"), F.first("vector").alias("vector"), F.min("vec_id").alias("first")), "vectors")
    rows = classes.select("node", "size", "vector").mapInArrow(
        _filtered(code, passed, pa.float32() if single else pa.float64()), f"filter bigint, node bigint, size bigint, passed array<int>, vector {kind}")
    crowded = rows.groupBy("filter").count().where(F.col("count") > cell).select("filter", F.ceil(F.col("count") / cell).cast("int").alias("k"))
    dealt = rows.join(crowded, "filter", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.col("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("filter", "node", "size", "passed", "vector", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    dealt = dealt.repartition("filter", "low", "high").sortWithinPartitions("filter", "low", "high")
    found = materialize(dealt.mapInArrow(_linked(cosine), "node bigint, links bigint, least bigint"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    named = classes.drop("vector").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    return marked.select("vec_id", "node").join(labels, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op2_near_vectors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
