"""Exact nearest neighbours for one query or for a table of queries.

``distance`` is the squared Euclidean distance, ``similarity`` is ``1 / (1 + distance)``; equal
distances are ordered by the key columns.

Two plans give the same result.  A query table with at most ``max_broadcast`` rows is shipped to
every task, and the corpus is read once, unshuffled: each task keeps its best ``k`` per query and
only those rows are shuffled.  A larger query table is written as blocks to shared storage, and every
corpus partition is searched where it lies against one portion of the blocks after the other.  No plan
ever emits the query x corpus pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.functions.vectors import similarity, squared_l2
from corpusmill.session import materialize

# --- fixed values -----------------------------------------------------------------------------
TOP_K, MAX_TOP_K = 5, 20
# ----------------------------------------------------------------------------------------------

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
CORPUS_BLOCK, QUERY_BLOCK = 8192, 2048
PORTION = 16  # query blocks that a task holds
TASKS_PER_CORE = 8  # that a search of blocks is dealt out to, unless its portions are more
SHARE = 1 << 10  # corpus blocks that a task reads past its portion
FILTER_BITS = 20  # the filter of hit keys has this power of two of 64-bit words at most
_CELLS = 1 << 20  # distances held at once inside a task
_SINGLE_MOST, _SINGLE_LEAST = 1e30, 1e-30  # squared lengths that single precision holds, and what it takes for zero
_EXACT_ROWS = 1 << 14  # vector pairs measured exactly at once


def check_k(k: int) -> int:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    return k


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    width = (flat.size // n if n else 0) if width is None else width
    sizes = pc.list_value_length(vectors)
    if n and not (sizes.null_count == 0 and pc.all(pc.equal(sizes, width)).as_py()):
        raise ValueError(f"every embedding must have {width} values")
    return flat.reshape(n, width)


def _first_copies(keys: pa.Table, tile: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first ``k`` by key of their equal vectors."""
    group = np.unique(tile, axis=0, return_inverse=True)[1].reshape(-1)
    table = keys.append_column("_group", pa.array(group))
    order = pc.sort_indices(table, [("_group", "ascending"), *[(c, "ascending") for c in keys.column_names]]).to_numpy()
    sorted_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group, side="left")
    return order[place < k]


def _marked(marks: np.ndarray) -> np.ndarray:
    """Flat places of the few true marks; eight at once are skipped where none is."""
    flat = marks.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    some = np.flatnonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[some // 8] * 8 + some % 8, whole + np.flatnonzero(flat[whole:])])


class _Best:
    """Running best ``k`` rows per query over any number of batches."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = (queries * queries).sum(axis=1)
        self.doubled = {}  # per number type: what a row times it gives the distance
        self.worst = np.full(len(queries), np.inf)  # k-th best exact distance at the last merge
        self.rows: pa.Table | None = None
        self.pending: list[pa.Table] = []  # nominated and measured since then

    def _product(self, kind: type) -> np.ndarray:
        if kind not in self.doubled:
            self.doubled[kind] = np.vstack([-2.0 * self.queries.T, np.ones(len(self.queries)), self.norms]).astype(kind)
        return self.doubled[kind]

    def add(self, keys: pa.Table, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """Compare rows with all queries, or ``only`` with those at the given places."""
        step = max(1, _CELLS // max(1, len(self.queries) if only is None else len(only)))
        for start in range(0, len(vectors), step):
            self._add_tile(keys.slice(start, step), vectors[start:start + step], only)

    def _add_tile(self, keys: pa.Table, tile: np.ndarray, only: np.ndarray | None = None, copies: bool = True) -> None:
        norms = (tile * tile).sum(axis=1)
        asked = slice(None) if only is None else only
        lengths, worst = self.norms[asked], self.worst[asked]
        # Only a few rows come close, so single precision is enough to nominate them, unless it would overflow.
        kind = np.float32 if max(norms.max(), self.norms.max(initial=0)) < _SINGLE_MOST else np.float64
        approx = np.column_stack([tile, norms, np.ones(len(tile))]).astype(kind) @ self._product(kind)[:, asked]
        # The product form rounds differently from the direct form, so it only nominates rows:
        # everything within the rounding error of the k-th value is measured again exactly.
        slack = 8 * (tile.shape[1] + 8) * np.finfo(kind).eps * (norms.max() + lengths) + _SINGLE_LEAST
        limit = worst + slack
        if len(tile) > self.k and not np.isfinite(worst).all():  # later tiles are bounded by what was found
            limit = np.minimum(limit, np.partition(approx, self.k - 1, axis=0)[self.k - 1] + 2 * slack)
        row, query = np.divmod(_marked(approx <= limit.astype(kind)), max(1, len(lengths)))
        if not len(row):
            return
        if copies and len(row) > 4 * self.k * len(lengths):
            # Many rows at the same distance: of equal vectors only the first k by key can be hits.
            first = _first_copies(keys, tile, self.k)
            self._add_tile(keys.take(pa.array(first)), tile[first], only, copies=False)
            return
        query = query if only is None else only[query]
        distance = np.empty(len(row))
        for start in range(0, len(row), _EXACT_ROWS):
            part = slice(start, start + _EXACT_ROWS)
            difference = tile[row[part]] - self.queries[query[part]]
            distance[part] = (difference * difference).sum(axis=1)
        near = np.flatnonzero(distance <= self.worst[query])
        found = keys.take(pa.array(row[near])).append_column("_query", pa.array(query[near]))
        self.pending.append(found.append_column("distance", pa.array(distance[near])))
        if sum(t.num_rows for t in self.pending) >= self.k * len(self.queries):  # a merge sorts all that is kept
            self._merge()

    def _merge(self) -> None:
        if self.pending:
            rows = pa.concat_tables(self.pending if self.rows is None else [self.rows, *self.pending])
            self.rows, self.pending = self._keep(rows), []

    def _keep(self, rows: pa.Table) -> pa.Table:
        keys = [c for c in rows.column_names if c not in ("_query", "distance")]
        order = pc.sort_indices(rows, [("_query", "ascending"), ("distance", "ascending"), *[(c, "ascending") for c in keys]])
        rows = rows.take(order).combine_chunks()
        query = rows["_query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        full = place == self.k - 1
        self.worst[query[full]] = rows["distance"].to_numpy()[full]
        return rows.filter(pa.array(place < self.k))

    def result(self, query_ids: pa.Array, schema: pa.Schema) -> pa.Table:
        self._merge()
        if self.rows is None:
            return schema.empty_table()
        ids = query_ids.take(self.rows["_query"].combine_chunks())
        table = self.rows.drop_columns(["_query"]).append_column(schema.field(0).name, ids)
        return table.select(schema.names).cast(schema)


def _hit_fields(queries: DataFrame, corpus: DataFrame, query_id: str, keys: list[str]) -> list[T.StructField]:
    return [
        T.StructField(query_id, queries.schema[query_id].dataType),
        *[T.StructField(c, corpus.schema[c].dataType) for c in keys],
        T.StructField("distance", T.DoubleType()),
    ]


def _rank(local: DataFrame, query_id: str, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy("distance", *keys)
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", similarity(F.col("distance")))
    )


def bounded_queries(queries: DataFrame, query_id: str, vector: str, limit: int = MAX_BROADCAST_QUERIES) -> pa.Table | None:
    """The query vectors if there are at most ``limit`` and they are small, else None.

    The width of one vector tells how many fit, so no more than that is ever fetched.
    """
    asked = queries.select(query_id, vector)
    one = asked.limit(1).toArrow()
    fits = min(limit, MAX_BROADCAST_BYTES // max(1, one.nbytes)) if one.num_rows else limit
    table = asked.limit(fits + 1).toArrow()
    return table if table.num_rows <= fits else None


def _search_shipped(table: pa.Table, corpus: DataFrame, fields, query_id, keys, vector, k) -> DataFrame:
    ids = table[query_id].combine_chunks()
    matrix = _matrix(table[vector])
    schema = to_arrow_schema(T.StructType(fields))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(matrix, k)
        for batch in batches:
            if batch.num_rows and len(matrix):
                part = pa.Table.from_batches([batch])
                best.add(part.select(keys), _matrix(part[vector], matrix.shape[1]))
        yield from best.result(ids, schema).to_batches()

    return corpus.select(*keys, vector).mapInArrow(search, T.StructType(fields))


def packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """Runs of up to ``size`` rows of each partition as one Arrow stream each: ``(name_no, name)``, nothing is moved."""
    schema = to_arrow_schema(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_table(rows.cast(schema))
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    return df.mapInArrow(pack, T.StructType([T.StructField(name, T.BinaryType())]))


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _shares(spark: SparkSession, n_portions: int, blocks: int) -> int:
    """Shares of the corpus that each portion of the queries is searched in; every share has its own ``k`` hits of a query."""
    return max(1, -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // n_portions), -(-blocks // SHARE))


def _search_blocks(queries: DataFrame, corpus: DataFrame, fields, query_id, keys, vector, k) -> DataFrame:
    """Query blocks on shared storage, streamed past the corpus where it lies.

    Every task reads one corpus partition and the query blocks of one portion; the corpus is read once per portion
    and is neither shuffled nor copied.  A task keeps the best ``k`` of each query over all its corpus blocks.
    """
    schema = to_arrow_schema(T.StructType(fields))
    blocks = materialize(packed(queries.select(query_id, vector), QUERY_BLOCK, "asked"), "query-blocks").withColumn("asked_no", F.monotonically_increasing_id())
    n_blocks = blocks.count()
    n_portions = max(1, -(-n_blocks // PORTION))
    portions = blocks.coalesce(n_portions).hint("shuffle_replicate_nl")
    held = packed(corpus.select(*keys, vector), CORPUS_BLOCK, "rows")
    if n_portions > 1:  # every portion reads the corpus: what it is made from (joins, encoding) runs once
        held = materialize(held, "corpus-blocks")
        held = held.coalesce(_shares(held.sparkSession, n_portions, held.count()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[_Best, pa.Array]] = {}
        for batch in batches:
            for rows, number, asked in zip(*(batch.column(c) for c in ("rows", "asked_no", "asked")), strict=True):
                if number.as_py() not in best:
                    table = _unpacked(asked.as_py())
                    best[number.as_py()] = (_Best(_matrix(table[vector]), k), table[query_id].combine_chunks())
                own, table = best[number.as_py()][0], _unpacked(rows.as_py())
                own.add(table.select(keys), _matrix(table[vector], own.queries.shape[1]))
        for own, ids in best.values():
            yield from own.result(ids, schema).to_batches()

    pairs = held.crossJoin(portions)  # block by block, never row by row
    return pairs.mapInArrow(search, T.StructType(fields))


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    k: int = TOP_K,
    query_id: str = "query_id",
    vector: str = "embedding",
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Best ``k`` corpus rows of every query: ``query_id, <keys>, distance, rank, similarity``.

    ``query_id`` must be unique.  A corpus with fewer than ``k`` rows gives fewer hits, an empty
    one gives none.
    """
    check_k(k)
    fields = _hit_fields(queries, corpus, query_id, keys)
    shipped = bounded_queries(queries, query_id, vector, max_broadcast)
    if shipped is not None:
        local = _search_shipped(shipped, corpus, fields, query_id, keys, vector, k)
    else:
        local = _search_blocks(queries, corpus, fields, query_id, keys, vector, k)
    return _rank(local, query_id, keys, k)


def nearest_to_vector(corpus: DataFrame, query: list[float], keys: list[str], k: int = TOP_K, vector: str = "embedding") -> DataFrame:
    """Best ``k`` rows for one query vector (a top-k sort, no global sort)."""
    check_k(k)
    target = F.array(*[F.lit(float(x)) for x in query])
    near = corpus.select(*keys, squared_l2(F.col(vector), target).alias("distance")).orderBy("distance", *keys).limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy("distance", *keys)  # k rows only
    return near.withColumn("rank", F.row_number().over(order)).withColumn("similarity", similarity(F.col("distance")))


def threshold(hits: DataFrame, max_distance: float | None = None, min_similarity: float | None = None) -> DataFrame:
    """Drop hits beyond a distance or below a similarity; applied to the top-k, never before it."""
    if max_distance is not None:
        hits = hits.filter(F.col("distance") <= max_distance)
    if min_similarity is not None:
        hits = hits.filter(F.col("similarity") >= min_similarity)
    return hits


def most_similar(hits: DataFrame, key: str, query_id: str = "query_id") -> DataFrame:
    """The single best hit of every query."""
    best = F.min_by(F.struct(key, "similarity"), F.struct("distance", key))
    return hits.groupBy(query_id).agg(best.alias("_best")).select(query_id, f"_best.{key}", "_best.similarity")


def _filter_word(keys: list[str]):
    """Place and bits of a key in the filter of hits: one 64-bit word, four bits in it."""
    h = F.xxhash64(*keys)
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, s).bitwiseAND(63).cast("int")) for s in (0, 6, 12, 18)]
    return F.shiftrightunsigned(h, 64 - FILTER_BITS), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def likely_hits(chunks: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose key is in ``hits``, and a few others, found without moving any chunk.

    A Bloom filter of the hit keys is made as a table of at most ``2**FILTER_BITS`` words, whatever the
    number of hits, and broadcast; no hit is missed.  Four million keys let about one other chunk in
    two hundred through; far more keys let more through, never fewer.
    """
    word, bits = _filter_word(keys)
    words = hits.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return chunks.join(F.broadcast(words), (word == F.col("_word")) & (bits.bitwiseAND(F.col("_bits")) == bits), "left_semi")


def attach_chunks(hits: DataFrame, chunks: DataFrame, keys: list[str], n_hits: int | None = None) -> DataFrame:
    """Look up the chunk columns of every hit.

    With a known hit count (number of queries x k) below the shipping bound the hit keys are broadcast.
    Otherwise a Bloom filter of them is.  Either way the chunk table is scanned in place, and only texts
    of hits are shuffled to their hits.  Of equal copies one is kept, as every copy already has a hit of its own.
    """
    if n_hits is not None and n_hits <= MAX_BROADCAST_QUERIES * MAX_TOP_K:
        found = chunks.join(F.broadcast(hits.select(*keys).distinct()), keys, "left_semi")
    else:
        hits = materialize(hits, "hits")  # read twice, and the search should run once
        found = likely_hits(chunks, hits, keys)
    rest = [F.first(c).alias(c) for c in chunks.columns if c not in keys]
    return found.groupBy(*keys).agg(*rest).join(hits, keys)
