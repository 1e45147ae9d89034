"""Hard negatives per anchor and positive: shared candidate lists of anchor clusters, walked to a certificate.

Vectors become integers, ``floor(256 * x)``.  Anchors are clustered by direction (spherical k-means).  With
``a`` the largest angle between a cluster's centre and its members, no member ``q`` reaches a candidate ``x``
with more than ``|q| |x| cos(max(0, angle(x, centre) - a))``.  A cluster sorts the candidates by this bound
once, and all its members walk that one list; a member is done when the bound falls below the least score it can
still use.  The first walk finds each anchor's positives, the second one, for each positive, the best rows of
another label within its score window.

The candidates are dealt by a hash to segments of at most ``SEGMENT`` rows, the clusters are packed into groups
of at most ``GROUP`` anchors, and a task walks one segment for one group; the best of all segments are merged by
a window per anchor.  So nothing grows with the table but the number of tasks, and no pair is emitted that was
not among a segment's best.  Nothing but centres, counts and sample rows passes through the driver: centres are
fitted on ``SAMPLE`` anchors at most, which decides speed only.  A search of all anchors stays a product of rows
and anchors where directions have no clusters, as the certificate comes late there.

Defined cases: rows with a null id, label or vector, an empty vector, any null or non-finite component, or a
component of magnitude 65,536 or more (its scores would not fit a long) take no part.  Vectors of different
lengths are never compared.  Repeated rows are rows of their own: a repeated anchor is answered once per row, and
its copies are its positives.  Equal scores go by id.  Zero vectors take part with score 0.  Other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.registry import query
from corpusmill.session import materialize, read_table

SEGMENT, GROUP, SAMPLE, CLUSTERS = 65536, 4096, 16384, 256
POSITIVES, NEGATIVES = 5, 10
SCALE, LARGEST = 256, 1 << 24
STRIDE = 512  # list entries that members take at a time
LEAST = -(1 << 62)


def numbered(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, label, v)``: the rows that take part, as integers, written once so that row numbers hold."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST // SCALE))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & sound)
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                                   scaled.cast("array<int>").alias("v")), "vectors")


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def centres(anchors: DataFrame, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres by vector length, from at most ``SAMPLE`` anchors drawn by a hash."""
    drawn = anchors.select("v", F.xxhash64("row").alias("_draw")).orderBy("_draw").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in drawn:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    found = {}
    for length, rows in by_length.items():
        unit = _unit(np.array(rows, float))
        centre = unit[:max(1, min(CLUSTERS, len(unit) // 32))].copy()
        for _ in range(rounds):
            near = np.argmax(unit @ centre.T, axis=1)
            for c in range(len(centre)):
                if len(own := unit[near == c]):
                    centre[c] = _unit(own.sum(axis=0, keepdims=True))[0]
        found[length] = centre
    return found


def _near(rows: np.ndarray, centre: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(rows), int) if centre is None else np.argmax(_unit(rows) @ centre.T, axis=1)


def with_group(anchors: DataFrame, centre: dict[int, np.ndarray]) -> tuple[DataFrame, int]:
    """Anchors with their cluster and the group that searches for them, and the number of groups."""
    schema = anchors.schema

    def assign(batches):
        for batch in batches:
            length = np.array([len(v) for v in batch.column("v").to_pylist()], int)
            cluster = np.zeros(len(length), int)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                cluster[at] = _near(_matrix(batch.column("v").take(pa.array(at)), n), centre.get(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(length, pa.int32())], [*schema.names, "cluster", "length"])

    placed = materialize(anchors.mapInArrow(assign, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, cluster int, length int"), "anchors")
    group, filled, where = 0, 0, []
    for n, c, size in sorted(tuple(r) for r in placed.groupBy("length", "cluster").count().collect()):
        if filled and filled + size > GROUP:
            group, filled = group + 1, 0
        parts = -(-size // GROUP)
        where.append((n, c, group, parts))
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + size)
    table = placed.sparkSession.createDataFrame(where, "length int, cluster int, start int, parts int")  # a row per centre
    at = F.col("start") + F.pmod(F.xxhash64(F.lit(3), "row"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(table), ["length", "cluster"]).withColumn("grp", at).drop("start", "parts", "length"), group + 1


def _matrix(vectors, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(float)


class _Best:
    """The first ``k`` by (score down, id up) of each slot, and the score below which nothing counts."""

    def __init__(self, k: int, slots: int, least: np.ndarray):
        self.k, self.slots, self.worst = k, slots, least.copy()
        self.held = [np.empty(0, np.int64) for _ in range(4)]

    def add(self, slot, score, ids, row) -> None:
        if not len(slot):
            return
        slot, score, ids, row = (np.concatenate(x) for x in zip(self.held, (slot, score, ids, row), strict=True))
        order = np.lexsort((row, ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.worst[slot[place == self.k - 1]] = score[full]
        self.held = [slot[place < self.k], score[kept], ids[kept], row[kept]]


def walk(members: np.ndarray, least: np.ndarray, candidates: np.ndarray, centre: np.ndarray | None, offer) -> int:
    """Walk the list of one cluster for all ``members``; ``least()`` is each one's least useful score.

    ``offer(alive, at, scores)`` takes the scores of the members ``alive`` and the candidates ``at``.
    Returns the number of list entries met, summed over members.
    """
    norms, sizes = np.linalg.norm(candidates, axis=1), np.linalg.norm(members, axis=1)
    if centre is None:
        bound = norms
    else:
        angle = np.arccos(np.clip(_unit(candidates) @ centre, -1.0, 1.0))
        wide = np.arccos(np.clip(_unit(members) @ centre, -1.0, 1.0)).max()
        bound = np.where(norms > 0, norms * np.cos(np.maximum(0.0, angle - wide)), 0.0)
    order = np.argsort(-bound, kind="stable")
    slack = 1e-6 * (1.0 + norms.max(initial=0.0)) * (1.0 + sizes)  # rounding of angles
    exact = float(np.abs(members).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * members.shape[1] < 2.0**53
    alive, met = np.arange(len(members)), 0
    for start in range(0, len(order), STRIDE):
        alive = alive[bound[order[start]] * sizes[alive] + slack[alive] >= least()[alive]]
        if not len(alive):
            break
        at = order[start:start + STRIDE]
        a, b = members[alive], candidates[at]
        scores = (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T
        offer(alive, at, scores)
        met += len(alive) * len(at)
    return met


def _clusters(anchors: pa.Table, rows: pa.Table, centre: dict[int, np.ndarray]):
    """Members and candidates of each (length, cluster) of a task: positions and integer matrices."""
    sizes = [np.array([len(v) for v in t["v"].to_pylist()], int) for t in (anchors, rows)]
    cluster = anchors["cluster"].to_numpy()
    for n in np.unique(sizes[0]):
        there = np.flatnonzero(sizes[1] == n)
        if not len(there):
            continue
        candidates = _matrix(rows["v"].combine_chunks().take(pa.array(there)), n)
        for c in np.unique(cluster[sizes[0] == n]):
            own = np.flatnonzero((sizes[0] == n) & (cluster == c))
            middle = centre.get(n)
            yield own, _matrix(anchors["v"].combine_chunks().take(pa.array(own)), n), there, candidates, None if middle is None else middle[c]


def _cells(anchors: DataFrame, rows: DataFrame, segments: int, groups: int):
    """Both sides by (segment, group): every group meets every segment, in blocks."""
    left = anchors.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    right = rows.withColumn("seg", F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(segments)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy("seg", "grp").cogroup(right.groupBy("seg", "grp"))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, centre: dict, segments: int, groups: int, k: int = POSITIVES) -> DataFrame:
    """``(anchor, row, vec_id, score, rank)``: each anchor row's first ``k`` other rows of its label."""
    out = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        made = []
        for own, members, at_row, candidates, middle in _clusters(asked, there, centre):
            me, mine = asked["row"].to_numpy()[own], asked["label"].to_numpy()[own]
            row, ids, label = (there[c].to_numpy()[at_row] for c in ("row", "vec_id", "label"))
            best = _Best(k, len(own), np.full(len(own), LEAST, np.int64))

            def offer(alive, at, scores):
                use = (label[at][None, :] == mine[alive][:, None]) & (row[at][None, :] != me[alive][:, None]) & (scores >= best.worst[alive][:, None])
                m, x = np.nonzero(use)
                best.add(alive[m], scores[m, x], ids[at[x]], row[at[x]])

            walk(members, lambda: best.worst, candidates, middle, offer)
            slot, score, found, at = best.held
            made.append(pa.table([me[slot], at, found, score], schema=out))
        return pa.concat_tables(made) if made else out.empty_table()

    return _first(_cells(anchors, rows, segments, groups).applyInArrow(search, "anchor long, row long, vec_id long, score long"), ["anchor"], k)


def hard_negatives(vectors: DataFrame, every: int = 100, k: int = NEGATIVES, n_positives: int = POSITIVES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; anchors are ids divisible by ``every``."""
    spark = vectors.sparkSession
    rows = numbered(vectors.select("vec_id", "embedding", "label"))
    n = rows.count()
    segments = max(1, -(-n // SEGMENT), min(spark.sparkContext.defaultParallelism, n // 1024))
    centre = centres(rows.where(F.col("vec_id") % every == 0))
    anchors, groups = with_group(rows.where(F.col("vec_id") % every == 0), centre)
    anchors = materialize(anchors, "anchors")
    near = materialize(positives(anchors, rows, centre, segments, groups, n_positives), "positives")
    pairs = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("of"))  # n_positives at most
    asked = anchors.join(pairs.select(F.col("anchor").alias("row"), F.transform("of", lambda x: x["score"]).alias("scores")), "row")
    out = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        made = []
        for own, members, at_row, candidates, middle in _clusters(asked, there, centre):
            me, mine = asked["row"].to_numpy()[own], asked["label"].to_numpy()[own]
            row, ids, label = (there[c].to_numpy()[at_row] for c in ("row", "vec_id", "label"))
            high = np.full((len(own), n_positives), LEAST, np.int64)  # no positive: no window
            for i, scores in enumerate(asked["scores"].take(pa.array(own)).to_pylist()):
                high[i, :len(scores)] = scores
            opens = high >= 0  # below 0 the window is empty
            top, low = np.where(opens, high * 9 // 10, -1), np.where(opens, -(-high * 3 // 10), 0)
            best = _Best(k, high.size, low.reshape(-1))

            def least():
                # the member needs what any of its windows can still take
                return np.where(opens, best.worst.reshape(high.shape), 1 << 62).min(axis=1)

            def offer(alive, at, scores):
                other = label[at][None, :] != mine[alive][:, None]
                for j in range(n_positives):
                    slot = alive * n_positives + j
                    use = other & opens[alive, j][:, None] & (scores <= top[alive, j][:, None]) & (scores >= best.worst[slot][:, None])
                    m, x = np.nonzero(use)
                    best.add(slot[m], scores[m, x], ids[at[x]], row[at[x]])

            walk(members, least, candidates, middle, offer)
            slot, score, found, at = best.held
            made.append(pa.table([me[slot // n_positives], (slot % n_positives + 1).astype(np.int32), at, found, score], schema=out))
        return pa.concat_tables(made) if made else out.empty_table()

    found = _cells(asked, rows, segments, groups).applyInArrow(search, "anchor long, place int, row long, vec_id long, score long")
    mined = _first(found, ["anchor", "place"], k).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return mined.join(named, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 65536)) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r)
QUALIFY row_number() OVER w <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))
