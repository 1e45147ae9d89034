"""Helpers shared by the operators: texts in Arrow batches, labelled samples, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.session import materialize, read_table

#: Bytes of text that a step in Python handles at once.
STEP_BYTES = 4 << 20

#: What a worker makes once per process and uses again in later tasks, and the module it was made for.
_MADE: dict = {}
_OWNER: list[str] = [""]


def _hand_back() -> None:
    """Give memory that is free within the process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def _release() -> None:
    """Forget what an earlier operator made and hand its memory back, as workers outlive operators."""
    _MADE.clear()
    _hand_back()


def _rest() -> None:
    """At the end of a task: made values that remember texts (they have ``rest``) let go of most; an idle worker's memory
    is in the way of whatever its executor does next, which need not be Python that could release it."""
    for made in _MADE.values():
        if hasattr(made, "rest"):
            made.rest()
    _hand_back()


def enter(operator: str) -> None:
    """Say which operator (the module of its functions) a worker works for from now on."""
    if operator != _OWNER[0]:
        _OWNER[0] = operator
        _release()


def once(key, make: Callable[[], object]):
    """The value of ``make()``, made once per worker process for each ``key`` while the operator stays the same."""
    enter(make.__module__)
    if key not in _MADE:
        if len(_MADE) > 64:
            _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of consecutive texts as bytes, each run at most ``limit`` bytes or one text."""
    texts = texts.cast(pa.large_binary())
    start, size, held = 0, 0, []
    for text in texts:
        value = text.as_py()
        if held and size + len(value or b"") > limit:
            yield start, held
            start, size, held = start + len(held), 0, []
        held.append(value)
        size += len(value or b"")
    if held:
        yield start, held


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores behind it, so that no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def annotate(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], maker: Callable[[], Callable], step: int = STEP_BYTES) -> DataFrame:
    """``df`` with columns computed from whole texts, in Arrow batches.

    ``maker()`` runs in the worker and returns a function from a list of texts (bytes or None; ``step`` bytes of
    them or one) to one list of values per field.  A column of ``df`` that has the name of a field is replaced.
    """
    names = [name for name, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in names or f.name == text]
    df = df.select(*[F.col(f"`{f.name}`") for f in kept])
    kept = [f for f in kept if f.name not in names]
    where = df.columns.index(text)
    keep_at = [df.columns.index(f.name) for f in kept]
    kinds = [to_arrow_type(kind) for _, kind in fields]

    def run(batches):
        enter(maker.__module__)  # also an operator that keeps nothing itself must not carry what the one before it kept
        work = maker()
        batch = columns = texts = column = values = made = None
        try:
            for batch in batches:
                columns = [[] for _ in names]
                for _, texts in steps(batch.column(where), step):
                    for column, values in zip(columns, work(texts), strict=True):
                        column.extend(values)
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep_at], *made], [*[f.name for f in kept], *names])
        finally:
            del work, batch, columns, texts, column, values, made
            _rest()

    return df.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, k) for n, k in fields]]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def text_key(text):
    """A hash that tells apart rows that share an id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo ``divisor`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int = 11) -> list[tuple[bytes, object]]:
    """Up to ``limit`` distinct labelled texts, chosen by a hash of the text, so in no order of the table.

    Rows without text or label are left out.  Equal texts count once, with their most frequent label.
    """
    drawn = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64(F.lit(seed), "text").alias("_draw"))  # texts stay where they are
    rows = (
        drawn.join(labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_label")), "doc_id")
        .groupBy("_draw").agg(F.mode("_label", True).alias("_label"), F.min("doc_id").alias("_first"))
        .orderBy("_draw").limit(limit)
    )
    chosen = [(r["_draw"], r["_label"], r["_first"]) for r in rows.collect()]
    ids = docs.sparkSession.createDataFrame([(i, y) for _, y, i in chosen], f"doc_id bigint, _label {rows.schema['_label'].dataType.simpleString()}")
    found = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("y"))
    return sorted((r["text"].encode("utf-8", "replace"), r["y"]) for r in found.collect())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links reduced to one link per row met, from the row to the smallest it hangs on."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (parent := up.get(x, x)) != x:
            up[x] = x = up.get(parent, parent)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 1_000_000:
            yield pa.RecordBatch.from_pydict({"u": list(up), "v": [root(x) for x in up]})
            up.clear()
    if up:
        yield pa.RecordBatch.from_pydict({"u": list(up), "v": [root(x) for x in up]})


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its smallest node.

    Each task first reduces its links to a forest; then large-star and small-star steps alternate
    until nothing changes.  The links of a round are a written table, so nothing is kept on the
    executors and no plan grows with the rounds.
    """
    links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = materialize(links.mapInArrow(_forest, "u bigint, v bigint").distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hung.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
