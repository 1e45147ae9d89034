"""Approximate nearest neighbours: vectors stored by the cell of a learned coarse quantiser, a few cells probed.

Cells come from Lloyd's rounds over a bounded sample; every vector goes to the cell of its nearest centre, and the
cell is the partition column of the stored table.  A search lists and reads the directories of the probed cells
only.  ``probes=None`` is the exact way: the nearest cells give each query a distance within which its answers
lie, and every other cell whose ball reaches that far is probed as well.

Two plans give the same hits.  While queries probe one or two cells each they are moved to their cells.  When they
probe more, a copy of each query per cell would outgrow both tables: then blocks of queries are streamed past the
stored cells instead, every task works out which cells its queries probe, and a query's hits of all cells that the
task reads are merged there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators.retrieval import CORPUS_BLOCK, PORTION, QUERY_BLOCK, TASKS_PER_CORE, TOP_K, _Best, _hit_fields, _matrix, _rank, _shares, _unpacked, check_k, knn, packed
from corpusmill.session import materialize

SAMPLE = 65536
MAX_CELLS = 4096
ROWS_PER_TASK = 65536
QUERIES_PER_TASK = 4096
CALIBRATION_QUERIES = 256
PROBES = 1 << 18  # queries times cells that are looked at, and probes that are emitted, at once
MOVED_PROBES = 2  # probes a query, on average, up to which queries are moved to their cells


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every row to every centre, as a matrix, and the nearest one."""
    squared = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2.0 * (rows @ centres.T)
    distance = np.sqrt(np.maximum(squared, 0.0))
    return distance, distance.argmin(axis=1)


def learn_centres(vectors: DataFrame, vector: str, cells: int, rounds: int = 10) -> np.ndarray:
    """``cells`` centres from at most ``SAMPLE`` vectors drawn by a hash of their values."""
    draw = F.xxhash64(vector).alias("_draw")
    last = vectors.select(draw).distinct().orderBy("_draw").limit(SAMPLE).agg(F.max("_draw")).first()[0]  # no vector is moved that is not drawn
    drawn = vectors.select(vector, draw).where(F.col("_draw") <= last).distinct().orderBy("_draw").limit(SAMPLE)
    rows = _matrix(drawn.select(vector).toArrow()[vector])
    centres = rows[:: max(1, len(rows) // cells)][:cells].copy()
    step = max(1, PROBES // max(1, len(centres)))
    for _ in range(rounds):
        near = np.concatenate([_nearest(rows[i:i + step], centres)[1] for i in range(0, len(rows), step)])
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


class CellIndex:
    """A table of vectors partitioned by cell, with the cells' centres, radii and sizes."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], vector: str = "embedding"):
        self.spark, self.path, self.keys, self.vector = spark, path.rstrip("/"), keys, vector
        self._about = None

    @classmethod
    def build(cls, corpus: DataFrame, path: str, keys: list[str], vector: str = "embedding", cells: int | None = None) -> CellIndex:
        """Store ``corpus`` by cell; about ``sqrt(rows)`` cells by default.  Rows without a vector are left out."""
        index = cls(corpus.sparkSession, path, keys, vector)
        rows = corpus.select(*keys, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        cells = cells or min(MAX_CELLS, max(1, round(rows.count() ** 0.5)))
        if rows.isEmpty():
            raise ValueError("a cell index needs vectors")
        centres = learn_centres(rows, vector, cells)
        schema, step = rows.schema, max(1, PROBES // len(centres))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    distance, near = _nearest(_matrix(batch.column(vector), centres.shape[1]), centres)
                    away = distance[np.arange(len(near)), near]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(near.astype(np.int32))], [*schema.names, "away", "cell"])

        placed = rows.mapInArrow(place, T.StructType([*schema.fields, T.StructField("away", T.DoubleType()), T.StructField("cell", T.IntegerType())]))
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{index.path}/rows")
        stored = index.spark.read.schema("away double, cell int").parquet(f"{index.path}/rows")
        sizes = {r["cell"]: (r["radius"], r["rows"]) for r in stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()}
        about = [(c, centres[c].tolist(), *sizes[c]) for c in sorted(sizes)]  # a row per cell
        index.spark.createDataFrame(about, "cell int, centre array<double>, radius double, rows long").coalesce(1).write.parquet(f"{index.path}/cells")
        return index

    def about(self) -> dict[str, np.ndarray]:
        if self._about is None:
            rows = sorted(self.spark.read.parquet(f"{self.path}/cells").collect())  # at most MAX_CELLS
            self._about = {"cell": np.array([r["cell"] for r in rows]), "centre": np.array([r["centre"] for r in rows]),
                           "radius": np.array([r["radius"] for r in rows]), "rows": np.array([r["rows"] for r in rows])}
        return self._about

    def load(self, cells: list[int] | None = None) -> DataFrame:
        """Stored rows, or those of some cells: only their directories are listed and read."""
        read = self.spark.read.option("basePath", f"{self.path}/rows")
        known = self.about()["cell"].tolist() if cells is None else cells
        return read.parquet(*[f"{self.path}/rows/cell={c}" for c in known]) if known else read.parquet(f"{self.path}/rows").limit(0)

    # ---- search ------------------------------------------------------------------------------

    def _probed(self, queries: DataFrame, query_id: str, choose) -> DataFrame:
        """``(query_id, vector, cell)`` for the cells that ``choose(distances, limits)`` marks per query."""
        about, vector, marks = self.about(), self.vector, self._marks(choose)
        names = [query_id, vector, *(["limit"] if "limit" in queries.columns else [])]
        fields = [queries.schema[query_id], queries.schema[vector], T.StructField("cell", T.IntegerType())]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch, marked in marks(whole):
                    row, cell = np.nonzero(marked)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(query_id).take(at), batch.column(vector).take(at), pa.array(about["cell"][cell].astype(np.int32))],
                                                     [query_id, vector, "cell"])

        return queries.select(*names).mapInArrow(probe, T.StructType(fields))

    def _marks(self, choose) -> Callable[[pa.RecordBatch | pa.Table], Iterator[tuple]]:
        """Gives the marks of ``choose`` for a batch of queries: runs of its rows, each with a matrix of rows and cells."""
        centres, vector = self.about()["centre"], self.vector
        step = max(1, PROBES // len(centres))

        def marks(whole):
            limited = "limit" in whole.schema.names
            for start in range(0, whole.num_rows, step):
                rows = whole.slice(start, step)
                distance, _ = _nearest(_matrix(rows.column(vector), centres.shape[1]), centres)
                yield rows, choose(distance, rows.column("limit").to_numpy()[:, None] if limited else None)

        return marks

    def _asked(self, queries: DataFrame, choose) -> dict[int, int]:
        """Number of queries that probe each cell, for the cells that any does."""
        marks, cells = self._marks(choose), self.about()["cell"].astype(np.int32)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = np.zeros(len(cells), np.int64)
            for whole in batches:
                for _, marked in marks(whole):
                    number += marked.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(cells[number > 0]), pa.array(number[number > 0])], ["cell", "n"])

        return dict(queries.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())  # at most MAX_CELLS rows

    def _search(self, queries: DataFrame, query_id: str, k: int, choose) -> DataFrame:
        """Best ``k`` of every query, of stored ones, in the cells that ``choose`` marks for it, or of each share of these cells."""
        asked, n = self._asked(queries, choose), queries.count()
        if sum(asked.values()) <= MOVED_PROBES * n:
            return self._search_moved(self._probed(queries, query_id, choose), asked, query_id, k)
        return self._search_streamed(queries, asked, n, query_id, k, choose)

    def _search_moved(self, probed: DataFrame, asked: dict[int, int], query_id: str, k: int) -> DataFrame:
        """Best ``k`` of every (query, cell); large cells and cells asked by many queries are split over tasks."""
        sizes = dict(zip(self.about()["cell"].tolist(), self.about()["rows"].tolist(), strict=True))
        rows = self.load(sorted(asked)).drop("away")
        fields = _hit_fields(probed, rows, query_id, self.keys)
        splits = [(c, -(-sizes[c] // ROWS_PER_TASK), -(-n // QUERIES_PER_TASK)) for c, n in asked.items()]
        parts = lambda: F.broadcast(self.spark.createDataFrame(splits, "cell int, row_parts int, query_parts int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
        left = rows.join(parts(), "cell").withColumn("_r", part("row_parts", *self.keys)).withColumn("_q", every("query_parts"))
        right = probed.join(parts(), "cell").withColumn("_q", part("query_parts", query_id)).withColumn("_r", every("row_parts"))
        schema, keys, vector = to_arrow_schema(T.StructType(fields)), self.keys, self.vector

        def search(there: pa.Table, asked: pa.Table) -> pa.Table:
            if not there.num_rows or not asked.num_rows:
                return schema.empty_table()
            best = _Best(_matrix(asked[vector]), k)
            best.add(there.select(keys), _matrix(there[vector], best.queries.shape[1]))
            return best.result(asked[query_id].combine_chunks(), schema)

        return left.groupBy("cell", "_r", "_q").cogroup(right.groupBy("cell", "_r", "_q")).applyInArrow(search, T.StructType(fields))

    def _search_streamed(self, queries: DataFrame, asked: dict[int, int], n: int, query_id: str, k: int, choose) -> DataFrame:
        """Best ``k`` of every query of the cells that a task reads; a query is written and moved once, whatever it probes.

        Every task holds one portion of the queries and reads whole cells past it, all of them when there are as many
        portions as tasks are wanted.  A row is compared with the queries that probe its cell only.
        """
        rows, sizes = self.load(sorted(asked)).drop("away"), dict(zip(self.about()["cell"].tolist(), self.about()["rows"].tolist(), strict=True))
        fields = _hit_fields(queries, rows, query_id, self.keys)
        blocks = -(-n // QUERY_BLOCK)
        n_portions = min(blocks, max(TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism, -(-blocks // PORTION)))
        n_shares = _shares(self.spark, n_portions, -(-sum(sizes[c] for c in asked) // CORPUS_BLOCK))
        portions = packed(queries.repartition(n_portions), QUERY_BLOCK, "asked").withColumn("asked_no", F.monotonically_increasing_id()).hint("shuffle_replicate_nl")
        held = packed(rows.select(*self.keys, self.vector, "cell").coalesce(n_shares), CORPUS_BLOCK, "rows")
        schema, keys, vector, marks = to_arrow_schema(T.StructType(fields)), self.keys, self.vector, self._marks(choose)
        place = {c: i for i, c in enumerate(self.about()["cell"].tolist())}

        def block(asked: pa.Table) -> tuple[_Best, np.ndarray, pa.Array]:
            """The queries, bits of those that probe each cell, and their keys."""
            marked = np.vstack([m for _, m in marks(asked)])
            return _Best(_matrix(asked[vector]), k), np.packbits(marked, axis=0).T.copy(), asked[query_id].combine_chunks()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[_Best, np.ndarray, pa.Array]] = {}
            for batch in batches:
                for there, number, asked in zip(*(batch.column(c) for c in ("rows", "asked_no", "asked")), strict=True):
                    if number.as_py() not in best:
                        best[number.as_py()] = block(_unpacked(asked.as_py()))
                    own, bits, _ = best[number.as_py()]
                    table = _unpacked(there.as_py())
                    cell, vectors, found = table["cell"].to_numpy(), _matrix(table[vector], own.queries.shape[1]), table.select(keys)
                    cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
                    for a, b in zip(cuts, cuts[1:]):
                        only = np.flatnonzero(np.unpackbits(bits[place[int(cell[a])]], count=len(own.queries)))
                        if len(only):
                            own.add(found.slice(a, b - a), vectors[a:b], None if len(only) == len(own.queries) else only)
            for own, _, ids in best.values():
                yield from own.result(ids, schema).to_batches()

        return held.crossJoin(portions).mapInArrow(search, T.StructType(fields))  # block by block, never row by row

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
        """Hits as :func:`knn` gives them; from the ``probes`` nearest cells, or exact ones without a number."""
        check_k(k)
        about, queries = self.about(), materialize(queries.select(query_id, self.vector), "asked")
        if probes is not None:
            nearest = max(1, min(probes, len(about["cell"])))
            found = self._search(queries, query_id, k, lambda d, _: _first_cells(d, np.full(len(d), nearest)))
            return _rank(found, query_id, self.keys, k)
        sizes = about["rows"]

        def enough(distance, _):
            """The nearest cells that together hold ``k`` rows."""
            order = distance.argsort(axis=1, kind="stable")
            return _first_cells(distance, (sizes[order].cumsum(axis=1) < k).sum(axis=1) + 1)

        limits = materialize(self._search(queries, query_id, k, enough).groupBy(query_id).agg(F.sort_array(F.collect_list("distance")).alias("d"), F.count(F.lit(1)).alias("n")).select(
            query_id, F.when(F.col("n") >= k, F.sqrt(F.get("d", F.lit(k - 1)))).otherwise(F.lit(float("inf"))).alias("limit")), "limits")
        radius = about["radius"]
        # the ball of a cell holds no answer if even its nearest point is farther than the k-th best known
        reach = lambda d, limit: d - radius[None, :] <= limit * (1 + 1e-9) + 1e-6
        found = self._search(materialize(queries.join(limits, query_id), "limited"), query_id, k, reach)
        return _rank(found, query_id, self.keys, k)

    def calibrate(self, queries: DataFrame, k: int = TOP_K, target: float = 0.9, query_id: str = "query_id") -> int:
        """The least power of two of probes (or all cells) whose recall on up to ``CALIBRATION_QUERIES`` queries reaches ``target``."""
        drawn = materialize(queries.select(query_id, self.vector).orderBy(F.xxhash64(query_id)).limit(CALIBRATION_QUERIES), "calibration")
        exact = materialize(knn(drawn, self.load(), self.keys, k, query_id, self.vector), "exact")
        wanted, probes, cells = exact.count(), 1, len(self.about()["cell"])
        while probes < cells:
            if recall(exact, self.search(drawn, k, probes, query_id), [query_id, *self.keys], wanted) >= target:
                return probes
            probes *= 2
        return cells


def _first_cells(distance: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Marks of the ``count`` nearest cells of each row."""
    place = np.empty_like(distance, dtype=int)
    np.put_along_axis(place, distance.argsort(axis=1, kind="stable"), np.arange(distance.shape[1])[None, :], axis=1)
    return place < count[:, None]


def recall(exact: DataFrame, found: DataFrame, keys: list[str], wanted: int | None = None) -> float:
    """Share of the exact hits that were found."""
    wanted = exact.count() if wanted is None else wanted
    return exact.select(*keys).join(found.select(*keys), keys).count() / max(1, wanted)
