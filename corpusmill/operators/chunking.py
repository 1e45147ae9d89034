"""Documents to overlapping chunks (one row per chunk)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import WHITE_SPACE, is_blank, strip
from corpusmill.operators.positions import with_position
from corpusmill.operators.rows import in_slices, unnest

# --- fixed values -----------------------------------------------------------------------------
# Coarse to fine; the empty separator cuts anywhere.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
# ----------------------------------------------------------------------------------------------


def check_settings(size: int, overlap: int) -> None:
    """Reject sizes without room, negative overlaps, and overlaps that would not advance."""
    if size < 1:
        raise ValueError(f"chunk size must be at least 1, got {size}")
    if overlap < 0:
        raise ValueError(f"chunk overlap must not be negative, got {overlap}")
    if overlap >= size:
        raise ValueError(f"chunk overlap {overlap} must be smaller than chunk size {size}")


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Character windows of ``size`` every ``size - overlap``, stripped, empty ones removed."""
    check_settings(size, overlap)
    step = size - overlap
    # one pass cuts the text in pieces of a step; a window is a piece with as much of its followers as the overlap takes
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.when(F.length(text) <= size, F.lit(0)).otherwise(F.ceil((F.length(text) - size) / step).cast("int"))

    def windows_of(pieces: Column) -> Column:
        joined = lambda i: F.array_join(F.slice(pieces, i + 1, F.lit(-(-size // step))), "")
        return F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.left(joined(i), F.lit(size))))

    # the pieces are one lambda argument, so they are computed once
    windows = F.flatten(F.transform(F.array(pieces), windows_of))
    return F.when(~is_blank(text), F.filter(windows, lambda w: w != ""))


def _cut_points(text: str, start: int, end: int, separator: str) -> list[int]:
    """Offsets that cut ``text[start:end]`` in front of every separator, both ends included."""
    if separator == "":
        return list(range(start, end + 1))
    cuts = [start]
    found = text.find(separator, start, end)
    while found != -1:
        if found > cuts[-1]:
            cuts.append(found)
        found = text.find(separator, found + len(separator), end)
    cuts.append(end)
    return cuts


def _pack(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy spans of whole pieces up to ``size``; a new span keeps up to ``overlap`` of the last."""
    first = 0
    for piece in range(len(cuts) - 1):
        piece_end = cuts[piece + 1]
        if piece > first and piece_end - cuts[first] > size:
            yield cuts[first], cuts[piece]
            while first < piece and (cuts[piece] - cuts[first] > overlap or piece_end - cuts[first] > size):
                first += 1
    yield cuts[first], cuts[-1]


def _spans(
    text: str, start: int, end: int, separators: list[str], size: int, overlap: int
) -> Iterator[tuple[int, int, bool]]:
    """Chunk spans as (start, end, packed); unpacked spans are emitted without stripping."""
    level = next((i for i, s in enumerate(separators) if text.find(s, start, end) != -1), len(separators))
    cuts = _cut_points(text, start, end, separators[level]) if level < len(separators) else [start, end]
    finer = separators[level + 1:] if level < len(separators) and separators[level] else []
    run = [cuts[0]]
    for left, right in zip(cuts, cuts[1:]):
        if right - left < size:
            run.append(right)
            continue
        if len(run) > 1:
            for a, b in _pack(run, size, overlap):
                yield a, b, True
        if finer:
            yield from _spans(text, left, right, finer, size, overlap)
        else:
            yield left, right, False
        run = [right]
    if len(run) > 1:
        for a, b in _pack(run, size, overlap):
            yield a, b, True


def split_text(
    text: str, separators: list[str] = SEPARATORS, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> list[str]:
    """Chunks of one text; every chunk is a stretch of the text."""
    if not text.strip(WHITE_SPACE):
        return []
    chunks = []
    for start, end, packed in _spans(text, 0, len(text), separators, size, overlap):
        chunk = text[start:end].strip() if packed else text[start:end]
        if chunk:
            chunks.append(chunk)
    return chunks


def split_texts(texts: pa.Array, separators: list[str] = SEPARATORS, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> pa.Array:
    """Chunks of each text of a batch; NULL for NULL."""
    return in_slices([texts], pa.list_(pa.string()), lambda rows: [None if t is None else split_text(t, separators, size, overlap) for t in rows])


def recursive_chunks(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: list[str] | None = None,
) -> Column:
    """Array of chunks cut at the coarsest separator that fits.

    Greedy packing with a carried-over tail is sequential inside a text, so this is an Arrow
    function over whole texts; Spark spreads the texts.  The character mode has a JVM-only twin,
    :func:`fixed_chunks`.
    """
    check_settings(size, overlap)
    levels = SEPARATORS if separators is None else list(separators)
    if levels == [""]:
        return fixed_chunks(text, size, overlap)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return split_texts(texts, levels, size, overlap)

    return split(text)


def chunk_table(docs: DataFrame, chunks: Column, text: str = "text") -> DataFrame:
    """One row per chunk with its number, the number of chunks and its length.

    All other columns of ``docs`` ride along as chunk metadata; texts without content give no row.
    """
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, chunks.alias("_chunks"))
    rows = unnest(cut, [*rest, F.size("_chunks").alias("total_chunks")], F.col("_chunks"), "chunk_id", "text")
    return rows.withColumn("chunk_size", F.length("text"))


def chunk_documents(
    docs: DataFrame,
    key: str = "doc_key",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: list[str] | None = None,
) -> DataFrame:
    """Chunks of the successfully parsed documents with their position among all documents.

    ``document_index`` counts failed documents too, so it is taken before they are dropped.
    """
    numbered = with_position(docs, key, "document_index").filter("success")
    return chunk_table(numbered.drop("success", "error"), recursive_chunks(F.col("text"), size, overlap, separators))


def chunk_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Number, mean, smallest, largest and total size of chunks; zeros for an empty table."""
    n = F.length(text)
    zero = F.lit(0).cast("bigint")
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chunk_size"),
        F.coalesce(F.min(n).cast("bigint"), zero).alias("min_chunk_size"),
        F.coalesce(F.max(n).cast("bigint"), zero).alias("max_chunk_size"),
        F.coalesce(F.sum(n).cast("bigint"), zero).alias("total_characters"),
    )
