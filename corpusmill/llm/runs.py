"""Long repeated passages by a run-length compressed Burrows-Wheeler index.

Every byte covered by a string of ``width`` bytes that also starts elsewhere is found, in the same or in
another text.  The work is dealt out by content:

1. Each window of ``width`` bytes names an anchor: of the ``GRAM``-byte strings inside it the one with the
   least hash, the last of equals.  Equal windows name equal anchors, so a window only has to be compared
   with windows of the same anchor.  Neighbouring windows with one anchor are one *context*.
2. Contexts are counted by a 128-bit digest (partial counts first).  A context that occurs twice repeats as a
   whole.  One that occurs once, at an anchor that has other contexts, needs a closer look; these contexts and
   one of each context beside them are fetched from the texts.
3. Contexts dealt by anchor are indexed some at a time: suffix order, its Burrows-Wheeler transform cut into
   runs, and for both ends of each run the text position and the match length with the neighbouring row.  All
   other matching statistics follow by streaming over the text: inside a run a match just gets one shorter
   with each step.  Positions whose match reaches ``width`` start a repeated window.
4. An anchor with more contexts than one index may hold is settled by the digests of its windows instead,
   counted in the same way, so no group has to fit one task and the result is the same.

Nulls: null text is an empty text; rows with a null id are rows like others.  Repeated rows are repeats of
each other.  Texts shorter than ``width`` have no repeats.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import documents, once, steps, text_key
from corpusmill.llm.registry import query
from corpusmill.session import materialize

WIDTH = 400
#: Bytes of a word where passages are measured in words, and of an anchor there.
CODE, WORDS_GRAM = 4, 32
#: Bytes of an anchor.
GRAM = 128
#: Contexts at one anchor, and bytes, that one index may hold.
INDEX_CONTEXTS = 4000
INDEX_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 24
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make():
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    return once(("powers", max(16, (n - 1).bit_length())), make)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes of ``data``."""
    n = len(data)
    if n < gram:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, from minima within blocks."""
    n = len(values)
    blocks = -(-n // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - size + 1], ahead[size - 1:n])


def anchored(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, anchor hash, first, last)`` of each context; starts are counted within the text."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < width or sizes.max() < width:
        return none, none, none, none
    if len(data) >= 1 << _POSITION_BITS:
        parts = [anchored_long(t, width, gram) for t in texts]
        number = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
        return number, *[np.concatenate([p[i] for p in parts]) for i in range(3)]
    h = gram_hashes(data, gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = window_minimum((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), width - gram + 1)
    at = (low - (least & low)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    number = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    start = np.arange(len(at))
    inside = np.nonzero(start + width <= ends[number])[0]
    number, at = number[inside], at[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (number[1:] != number[:-1])
    firsts = np.nonzero(new)[0]
    lasts = np.append(firsts[1:], len(inside)) - 1
    number = number[firsts]
    return number, h[at[firsts]].view(np.int64), inside[firsts] - begins[number], inside[lasts] - begins[number]


def anchored_long(text: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a text too long for one pass: stretches of it that overlap by a window less a byte."""
    stretch = (1 << _POSITION_BITS) - 1
    out = []
    for s in range(0, max(1, len(text) - width + 1), stretch - width + 1):
        _, h, a, b = anchored([text[s:s + stretch]], width, gram)
        out.append((h, a + s, b + s))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only rows that are still tied are sorted again."""
    n = len(symbols)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = symbols
    key = padded[:n] << np.uint64(48) | padded[1:n + 1] << np.uint64(32) | padded[2:n + 2] << np.uint64(16) | padded[3:n + 3]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    heads = np.ones(n, bool)
    heads[1:] = sorted_key[1:] != sorted_key[:-1]
    step = 4
    while True:
        first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[order] = first
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        slots = np.nonzero(tied)[0]
        if not len(slots):
            return order
        rows = order[slots]
        beyond = rows + step
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[rows] << 32 | after
        sort = np.argsort(key)
        rows, key = rows[sort], key[sort]
        order[slots] = rows
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads[slots] = fresh
        step *= 2


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text, the starts of ``width`` bytes that occur at another place of these texts too."""
    count = len(texts)
    if count + 257 >= 1 << 16:
        raise ValueError("too many texts for one index")
    # each text is followed by a symbol of its own, so no match goes on past its end
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = raw.astype(np.int32) + count + 1
    symbols[ends - 1] = np.arange(1, count + 1)
    n = len(symbols)
    order = suffix_order(symbols)
    last = np.where(order > 0, symbols[order - 1], 0)  # the transform
    heads = np.nonzero(np.append(True, last[1:] != last[:-1]))[0]  # where its runs begin
    here, above = order[heads[1:]], order[heads[1:] - 1]  # text positions at both sides of each border of runs
    size = np.zeros(len(here), np.int64)
    live = np.arange(len(here))
    padded = np.append(symbols, [0, 0])
    while len(live):
        live = live[padded[here[live] + size[live]] == padded[above[live] + size[live]]]
        size[live] += 1
    # match with the row above and below: sampled at run ends, one shorter with every step elsewhere
    best = np.zeros(n, np.int64)
    position = np.arange(n)
    for sampled, lengths, edge in ((here, size, order[0]), (above, size, order[-1])):
        known = np.zeros(n, bool)
        value = np.zeros(n, np.int64)
        known[sampled], value[sampled] = True, lengths
        known[edge], known[0] = True, True
        source = np.maximum.accumulate(np.where(known, position, 0))
        best = np.maximum(best, value[source] - (position - source))
    hit = np.nonzero(best >= width)[0]
    owner = np.searchsorted(ends, hit, side="right")
    cut = np.searchsorted(owner, np.arange(count + 1))
    return [hit[cut[i]:cut[i + 1]] - (ends[i] - sizes[i]) for i in range(count)]


def _spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows at ``starts`` (ascending)."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > width)[0]
    firsts, lasts = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + width).tolist(), strict=True))


_PLACE = "doc_id bigint, text_key bigint"


def contexts(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Every context of ``docs(doc_id, text_key, text)``: anchor, digest, first and last window start."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for start, texts in steps(batch.column(2)):
                texts = [t or b"" for t in texts]
                number, anchor, first, last = anchored(texts, width, gram)
                digest = xxhash.xxh3_128_digest
                digests = [digest(texts[i][a:b + width]) for i, a, b in zip(number.tolist(), first.tolist(), last.tolist(), strict=True)]
                at = pa.array(number + start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(anchor, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    ["doc_id", "text_key", "anchor", "digest", "first", "last"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"{_PLACE}, anchor bigint, digest binary, first bigint, last bigint")


def _units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word; in scripts that do not set spaces each character is one."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    after = np.append(data[1:], 0)
    alone = (data >= 0xE3) & (data <= 0xE9)  # kana, Han and their punctuation; then Thai, Lao, Myanmar, Khmer
    alone |= (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    alone |= (data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if alone.any():
        begins |= alone
        begins[3:] |= alone[:-3] & inside[3:]
    first = np.nonzero(begins)[0]
    gaps = np.append(np.nonzero(~inside)[0], len(data))
    return first, np.minimum(np.append(first[1:], len(data)), gaps[np.searchsorted(gaps, first)])


def _codes(text: bytes) -> bytes:
    """``CODE`` bytes for each word, a hash of its bytes."""
    first, end = _units(text)
    up, down = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * down[:len(text)], out=sums[1:])
    h = (sums[end] - sums[first]) * up[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype("<u4").tobytes()


def coded(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text_key, text)`` with the codes of the words in place of the text."""
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("text", T.BinaryType())])

    def run(batches):
        for batch in batches:
            codes = [_codes(t or b"") for _, texts in steps(batch.column(2)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["doc_id", "text_key", "text"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, kinds)


def in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of the words whose codes ``spans`` cover, with what stands between them."""
    if not spans:
        return []
    first, end = _units(text)
    out = []
    for a, b in merged(spans):
        a, b = -(-a // CODE), b // CODE
        if a < b:
            out.append((int(first[a]), int(end[b - 1])))
    return out


def _fetch(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted(doc_id, text_key, anchor, first, last, alone, hot)`` with the bytes of each context."""
    per_text = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "first", "last", "alone", "hot")).alias("w"))
    found = docs.alias("d").join(per_text.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key")))
    found = found.select("d.doc_id", "d.text_key", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"), F.explode("w").alias("w"))
    return found.select("doc_id", "text_key", "w.*", F.substring(F.col("b"), (F.col("w.first") + 1).cast("int"), (F.col("w.last") - F.col("w.first") + width).cast("int")).alias("bytes"))


def _settle(width: int):
    """Spans of the contexts that occur once, from an index over neighbouring rows with whole anchors."""

    def run(batches):
        held, size = [], 0

        def settle():
            out = ([], [], [], [])
            for (doc_id, key, _, first, alone, _), starts in zip(held, repeated_starts([h[5] for h in held], width), strict=True):
                if alone:
                    for a, b in _spans(starts, width):
                        for column, value in zip(out, (doc_id, key, first + a, first + b), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "text_key", "start", "stop"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5)], strict=True):
                if size >= INDEX_BYTES and row[2] != held[-1][2]:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settle()

    return run


def _windows(width: int):
    """Every window of the contexts with its digest."""

    def run(batches):
        for batch in batches:
            for doc_id, key, first, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                n = len(text) - width + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(text[i:i + width]) for i in range(n)], pa.binary())], ["doc_id", "text_key", "start", "digest"])

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, index_contexts: int = INDEX_CONTEXTS) -> DataFrame:
    """``(doc_id, text_key, start, stop)``: bytes of ``docs(doc_id, text_key, text)`` that repeat; may overlap."""
    if not 1 <= gram <= width:
        raise ValueError("an anchor lies inside a window")
    rows = materialize(contexts(docs, width, gram), "contexts")
    counted = materialize(
        rows.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "first", "last")).alias("place")).where("n > 0"), "counted")
    whole = rows.join(counted.where("n > 1").select("anchor", "digest"), ["anchor", "digest"]).select("doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + width).alias("stop"))
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("alone")).where("kinds > 1 and alone > 0")
    wanted = counted.join(anchors.select("anchor", "kinds"), "anchor").select("place.*", "anchor", (F.col("n") == 1).alias("alone"), (F.col("kinds") > index_contexts).alias("hot"))
    fetched = materialize(_fetch(docs, wanted, width), "fetched")
    dealt = fetched.where("not hot").select("doc_id", "text_key", "anchor", "first", "alone", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    indexed = dealt.mapInArrow(_settle(width), f"{_PLACE}, start bigint, stop bigint")
    windows = materialize(fetched.where("hot").select("doc_id", "text_key", "first", "bytes").mapInArrow(_windows(width), f"{_PLACE}, start bigint, digest binary"), "windows")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    split = windows.join(twice, "digest").select("doc_id", "text_key", "start", (F.col("start") + width).alias("stop"))
    return whole.unionAll(indexed).unionAll(split)


def with_spans(docs: DataFrame, width: int = WIDTH, words: int | None = None, **options) -> DataFrame:
    """``docs(doc_id, text_key, text, ...)`` with ``spans``, an array of (start, stop) to cut, unordered.

    With ``words`` a passage has that many words instead of ``width`` bytes, whatever white space stands
    between them, and the spans count in codes of words (see ``in_bytes``).
    """
    if words is None:
        spans = repeated_spans(docs, width, **options)
    else:
        spans = repeated_spans(coded(docs), words * CODE, **{"gram": min(WORDS_GRAM, words * CODE)} | options)
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left")
    return found.select("d.*", "s.spans")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``text``, and the maximal runs that go."""
    runs = merged(spans)
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), [(a, b) for a, b in runs]


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its id as a long, its text, and a key of the text that tells apart rows that share an id."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text, "doc_id", "text", "text_key", "spans")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"), *rest)


def _each_cut(batch: pa.RecordBatch, at_text: int, at_spans: int, in_words: bool = False):
    starts = batch.column(at_spans).to_pylist()
    i = 0
    for _, texts in steps(batch.column(at_text)):
        for text in texts:
            text, spans = text or b"", [(s["start"], s["stop"]) for s in starts[i] or []]
            yield text, *cut(text, in_bytes(text, spans) if in_words else spans)
            i += 1


def without_repeats(docs: DataFrame, width: int = WIDTH, words: int | None = None, **options) -> DataFrame:
    """``docs(doc_id, text, ...)`` with all repeated passages cut, of ``width`` bytes or of ``words``; documents of nothing else go.

    Characters that a cut goes through go too.
    """
    plain = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = with_spans(keyed(plain), width, words, **options).select("text", "spans", F.col("row").dropFields("text").alias("row"))
    kept = [found.schema["text"], found.schema["row"]]

    def run(batches):
        for batch in batches:
            texts = [kept.decode("utf-8", "ignore") if gone else text.decode("utf-8", "replace") for text, kept, gone in _each_cut(batch, 0, 1, words is not None)]
            gone = pa.array([bool(s) for s in batch.column(1).to_pylist()], pa.bool_())
            blank = pa.array([not t.strip() for t in texts], pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "row"])
            yield made.filter(pc.invert(pc.and_(gone, blank)))

    left = found.mapInArrow(run, T.StructType(kept))
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()) for text, kept, gone in _each_cut(batch, 1, 2)]
            sizes, removed, spans, digests = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)], pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(keyed(documents(spark, sf_dir))).select("doc_id", "text", "spans")
    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
