"""Benchmark items in documents, found by latent semantic retrieval.

1. One pass counts the document frequency of hashed words over all documents.
2. The latent space is a randomised singular value decomposition of the TF-IDF matrix of passages: tasks add up
   ``A'(A G)`` for a random matrix ``G`` and the driver solves a small eigenproblem (Nystroem).  It is fitted on all
   documents, equal texts once, and on the items.  Words count once per passage there; words of ``COMMON`` of all
   documents or more have no direction, else the leading directions would tell languages and repeated words apart and
   nothing more.
3. Texts are read a block of ``STRIDE`` words at a time.  Windows of as many blocks as an item can touch are folded
   into the latent space; those whose cosine with an item is at least ``NOMINATE`` are its candidates.  They are verified
   with one more block at each end, unless they share fewer than ``PARAPHRASE`` of the item's words, as then no common
   subsequence can be long enough.
   Items that words without a direction alone could make a copy of (``COPY`` of their words) have no cosine to go by: for
   these the words that a window shares with them are counted, a word as often as the item has it, and every window that
   shares ``PARAPHRASE`` of the item is verified, which loses none.
4. The longest common subsequence of the item's words and the window's decides: a document is contaminated when
   it holds ``COPY`` of the item, or ``PARAPHRASE`` of it together with the item's answer, the words of its last
   sentence in one piece.  An answer of fewer than ``ANSWER_WORDS`` words has to stand at its place, after matched words of
   the question; an item of one sentence has its last ``ANSWER_WORDS`` words as answer.

Benchmark items are a stated query set; they go to the tasks in blocks of at most ``ITEM_BLOCK`` rows and
``ITEM_BYTES`` bytes, with one pass per block.  What is gathered on the driver has a fixed size: ``BUCKETS`` rows.

Nulls: null or empty texts hold no item; items without words are found nowhere; null ids stay null.  Repeated
rows give repeated rows.  Without items no document is contaminated; empty tables give an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, documents, free_name, once, steps
from corpusmill.llm.registry import query
from corpusmill.session import read_table

BUCKETS = 1 << 15
DIMENSIONS = 48
PASSAGE = 64
STRIDE = 8
COPY, PARAPHRASE = 0.7, 0.5
#: Words of an answer that decides wherever it stands.
ANSWER_WORDS = 3
#: Windows times items that are counted at once.
CELLS = 4 << 20
#: Share and number of all documents that a word without a direction is in.
COMMON, COMMON_LEAST = 0.02, 32
#: Least cosine of a candidate.
NOMINATE = 0.35
ITEM_BLOCK, ITEM_BYTES = 4096, 16 << 20
SEED = 23
#: Columns of the table of words that an item can hold, and candidates that are looked up in it at once.
MARKS, PAIRS = 4096, 16384
#: Passages or blocks that are folded at once.
ROWS = 16384
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Bytes of text whose words are in memory as vectors at once.
PART = 512 << 10
#: What is taken off the ends of a word.
_ENDS = string.punctuation + "\u00a1\u00ab\u00b7\u00bb\u00bf\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u2039\u203a\u3001\u3002"


_CORE, _END, _SPACE, _LEAD = range(4)
#: Bytes that the first byte of a character above ASCII can be, of those that are white space or ends of words.
_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_FACTOR = 0x9E3779B97F4A7C15


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each code point below U+4000 is in a word, the same for bytes, and a random number per byte."""
    points = np.array([_SPACE if chr(c).isspace() else _END if chr(c) in _ENDS else _CORE for c in range(0x4000)], np.uint8)
    table = np.zeros(256, np.uint8)
    table[:128] = points[:128]
    table[list(_LEADS)] = _LEAD
    return points, table, np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    def made(factor: int) -> np.ndarray:
        row = np.full(n + 1, factor, np.uint64)
        row[0] = 1
        return np.cumprod(row, dtype=np.uint64)

    return made(_FACTOR), made(pow(_FACTOR, -1, 1 << 64))


def _word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of UTF-8 bytes that end in a space, without what is taken off its ends."""
    points, table, _ = once("decontamination kinds", _kinds)
    kind = table[data]
    at = np.flatnonzero(kind == _LEAD)
    if len(at):
        kind[at] = _CORE
        lead, second = data[at].astype(np.int32), data[at + 1].astype(np.int32) & 63
        wide = lead != 0xC2
        third = data[np.where(wide, at + 2, at)].astype(np.int32) & 63
        what = points[np.where(wide, (lead & 15) << 12 | second << 6 | third, 0x80 | second)]
        some = what != _CORE
        at, what, wide = at[some], what[some], wide[some]
        kind[at] = kind[at + 1] = what
        kind[at[wide] + 2] = what[wide]
    core = np.zeros(len(data) + 1, np.int8)
    core[1:] = kind == _CORE
    edge = np.diff(core)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends
    run = np.cumsum(kind == _SPACE, dtype=np.int32)[starts]  # pieces with no white space between them are one word
    apart = np.flatnonzero(run[1:] != run[:-1])
    return starts[np.append(0, apart + 1)], ends[np.append(apart, len(ends) - 1)]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of some bytes; a polynomial hash, from one running sum over all of them."""
    first, end = _word_places(data)
    numbers = once("decontamination kinds", _kinds)[2]
    up, down = once(("decontamination powers", PIECE), lambda: _powers(PIECE)) if len(data) <= PIECE else _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * up[:len(data)], out=total[1:])
    h = (total[end] - total[first]) * down[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return first, (h >> np.uint64(2)).astype(np.int64)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the number of words of each text.

    A word is what stands between white space, in lower case and without outer punctuation.
    """
    held = pa.array([(t or b"") + b" " for t in texts], pa.large_binary())
    try:
        lower = pc.utf8_lower(held.cast(pa.large_string()))
    except pa.ArrowInvalid:  # not UTF-8
        lower = pc.utf8_lower(pa.array([t.as_py().decode("utf-8", "replace") for t in held], pa.large_string()))
    borders = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset:lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8)[borders[0]:borders[-1]] if len(lower) else np.empty(0, np.uint8)
    firsts, hashes, low = [], [], 0
    while low < len(data):
        high = min(low + PIECE, len(data))
        if high < len(data):  # behind the last space of the piece, or the next one
            spaces = np.flatnonzero(data[low:high] == 32)
            while not len(spaces):
                spaces = np.flatnonzero(data[high:high + PIECE] == 32) + high - low
                high += PIECE
            high = low + int(spaces[-1]) + 1
        first, found = _hashed(data[low:high])
        firsts.append(first + low)
        hashes.append(found)
        low = high
    if not hashes:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(borders - borders[0], np.concatenate(firsts), "right") - 1
    return np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


class Words:
    """The words of one text."""

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        return word_hashes([text.encode("utf-8", "replace")])[0]


def _distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per owner, in order."""
    key = owner * BUCKETS + bucket
    key.sort()
    return np.divmod(key[np.flatnonzero(np.append(True, key[1:] != key[:-1]))], BUCKETS)


def gaussian(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return once(("gaussian", buckets, dimensions, seed), lambda: np.random.default_rng(seed).standard_normal((buckets, dimensions)).astype(np.float32))


def _blocks(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, counted over all texts, and the number of blocks per text of ``sizes`` words."""
    counts = -(-sizes // size)
    begins = np.cumsum(sizes) - sizes
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(begins, counts) + number * size, counts


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """``(documents per bucket, documents)`` over all of ``docs(text)``."""

    def run(batches):
        found, count = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            count += batch.num_rows
            for _, texts in steps(batch.column(0), PART):
                hashes, sizes = word_hashes(texts)
                if len(hashes):
                    found += np.bincount(_distinct(np.repeat(np.arange(len(sizes)), sizes), hashes % BUCKETS)[1], minlength=BUCKETS)
        at = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(found[at], count), pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(BUCKETS, np.int64)
    for r in rows:  # at most BUCKETS rows and one, whatever the corpus
        if r["bucket"] >= 0:
            frequency[r["bucket"]] = r["n"]
    return frequency, sum(r["n"] for r in rows if r["bucket"] < 0)


def word_weights(frequency: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(weight, whether common)`` per bucket."""
    common = frequency >= max(COMMON_LEAST, COMMON * count)
    return np.where(common, 0.0, np.log((count + 1) / (frequency + 1)) + 0.02), common


def sketch(docs: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``A'(A G)`` of the weighted passages of ``docs(text)``."""
    narrow, rows = weights.astype(np.float32), ROWS

    def run(batches):
        total = np.zeros((DIMENSIONS, BUCKETS))
        g = gaussian() * narrow[:, None]
        for batch in batches:
            for _, texts in steps(batch.column(0), PART):
                hashes, sizes = word_hashes(texts)
                if not len(hashes):
                    continue
                first, _ = _blocks(sizes, PASSAGE)
                passage = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
                bucket = hashes % BUCKETS
                use = narrow[bucket] > 0
                if not use.any():
                    continue
                passage, bucket = _distinct(passage[use], bucket[use])
                heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                for low in range(0, len(heads), rows):
                    own = heads[low:low + rows]
                    end = heads[low + rows] if low + rows < len(heads) else len(bucket)
                    part = bucket[own[0]:end]
                    folded = np.add.reduceat(g[part], own - own[0], axis=0).T.copy()
                    row = np.repeat(np.arange(len(own)), np.diff(np.append(own, end)))
                    for sums, values in zip(total, folded, strict=True):
                        sums += np.bincount(part, values[row], BUCKETS)
        total = total.T
        at = np.nonzero(total.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in total[at].astype(np.float32)], pa.binary())], ["bucket", "row"])

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[bucket] = rows.get(bucket, 0) + np.frombuffer(row, np.float32).astype(np.float64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([r.astype(np.float32).tobytes() for r in rows.values()], pa.binary())], ["bucket", "row"])

    schema = "bucket bigint, row binary"
    # a bucket has one row per task of the sample, so dealing by bucket is even
    parts = docs.select("text").mapInArrow(run, schema).repartition("bucket").mapInArrow(add, schema)
    total = np.zeros((BUCKETS, DIMENSIONS))
    for r in parts.toLocalIterator():  # at most BUCKETS rows
        total[r["bucket"]] = np.frombuffer(r["row"], np.float32)
    return total * weights[:, None]


def latent_space(total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each word adds to a folded passage: ``weight * U``, one row per bucket; cosines are those of the passages in the space."""
    small = gaussian().astype(np.float64).T @ total
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > values.max() * 1e-9 if values.max() > 0 else np.zeros(len(values), bool)
    if not good.any():
        return np.zeros((BUCKETS, 1), np.float32)
    half = total @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    keep = s > s[0] * 1e-6
    return (weights[:, None] * u[:, keep]).astype(np.float32)


def fitted(docs: DataFrame, items: DataFrame) -> np.ndarray:
    """The latent space of ``docs(text)`` and ``items(text)``."""
    weights, _ = word_weights(*frequencies(docs))
    texts = docs.select("text").unionAll(items.select("text")).where("text is not null").distinct()
    return latent_space(sketch(texts, weights), weights)


def _places(a: list[int]) -> dict[int, int]:
    """Bits of the places of each word."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def _longest(matches: list[int], n: int) -> int:
    full = (1 << n) - 1
    row = full
    for places in matches:
        match = row & places
        row = (row + match | row - match) & full
    return n - row.bit_count()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of bits per row."""
    where = _places(a)
    return _longest([where[x] for x in b if x in where], len(a))


def _starts(words: list[int], part: list[int]) -> list[int]:
    n = len(part)
    return [i for i in range(len(words) - n + 1) if words[i] == part[0] and words[i:i + n] == part]


class Item:
    def __init__(self, item_id, text: str, words: Words):
        self.id, self.words = item_id, words.hashes(text).tolist()
        self.where = _places(self.words)
        sentences = [s for s in (words.hashes(s).tolist() for s in re.split(r"(?<=[.!?])\s+", text.strip())) if s]
        self.answer = sentences[-1] if len(sentences) > 1 else self.words[-ANSWER_WORDS:]
        self.blocks = -(-len(self.words) // STRIDE) + 1

    def share(self, own: list[int]) -> float:
        where = self.where
        return _longest([where[x] for x in own if x in where], len(self.words)) / len(self.words)

    def answered(self, own: list[int]) -> bool:
        """Whether ``own`` holds the answer; a short one just behind words of the question that make up the share."""
        found = _starts(own, self.answer)
        if len(self.answer) >= ANSWER_WORDS:
            return bool(found)
        question = self.words[:len(self.words) - len(self.answer)]
        for i in found:
            matched = common_subsequence(question, own[:i])
            if matched + len(self.answer) >= PARAPHRASE * len(self.words) and matched > common_subsequence(question, own[:max(0, i - STRIDE)]):
                return True
        return False


class _Parts:
    """The words of some texts, cut into blocks, and the hits found in them."""

    def __init__(self, texts: list[bytes | None]):
        self.words, self.sizes = word_hashes(texts)
        self.stops = np.cumsum(self.sizes)
        self.first, counts = _blocks(self.sizes, STRIDE)
        self.ends = np.repeat(np.cumsum(counts), counts)
        self.starts = self.ends - np.repeat(counts, counts)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.marks = np.append(self.words % MARKS, MARKS).astype(np.int32)  # the last one stands for no word
        self.seen: dict[tuple[int, int], list] = {}

    def window(self, block: int, width: int) -> tuple[int, list[int]]:
        """The text of a block, and the words of ``width`` blocks from it on."""
        doc, begin = int(self.owner[block]), int(self.first[block])
        return doc, self.words[begin:min(begin + width * STRIDE, int(self.stops[doc]))].tolist()

    def hits(self) -> list[list]:
        out: list[list] = [[] for _ in self.sizes]
        for (doc, _), hit in self.seen.items():
            out[doc].append(hit)
        return out


def _grouped(items: list[Item], known: np.ndarray) -> dict[int, tuple]:
    """Items by the number of blocks of their windows, with the items of each word and the least that a window shares."""
    groups = {}
    for blocks in sorted({i.blocks for i in items}):
        own = [i for i in items if i.blocks == blocks]
        rows = sorted((int(np.searchsorted(known, w)), j, places.bit_count()) for j, i in enumerate(own) for w, places in i.where.items())
        word, item, times = np.array(rows, np.int64).T
        first = np.searchsorted(word, np.arange(len(known) + 1))
        groups[blocks] = own, first, item, times.astype(np.float64), np.array([PARAPHRASE * len(i.words) for i in own])
    return groups


class Finder:
    """The items of a block, with their vectors in a latent space.

    ``search`` takes windows as candidates by their cosine, and for items that common words alone could make a copy of
    by counts; ``find`` does so by counts for every item, which is exact.
    """

    def __init__(self, items: list[tuple[object, str]], space: np.ndarray):
        self.words = Words()
        self.space = space
        self.rows = np.append(space, np.zeros((1, space.shape[1]), np.float32), axis=0).astype(np.float32)
        self.placed = space.any(axis=1)
        found = [i for i in (Item(*row, self.words) for row in items) if i.words]
        self.known = np.array(sorted({h for i in found for h in i.words}), np.int64)
        size = 1 << 12
        while len(np.unique(self.known % size)) < len(self.known) and size < 1 << 22:
            size *= 2
        self.slots = np.zeros(size, np.int64)
        self.slots[self.known % size] = np.arange(len(self.known))
        self.apart = len(np.unique(self.known % size)) == len(self.known)
        self.groups = _grouped(found, self.known)
        plain = [np.count_nonzero(~self.placed[np.array(i.words) % BUCKETS]) >= COPY * len(i.words) for i in found]
        self.by_count = _grouped([i for i, p in zip(found, plain, strict=True) if p], self.known)
        self.by_cosine: dict[int, tuple] = {}
        for blocks in sorted({i.blocks for i, p in zip(found, plain, strict=True) if not p}):
            own = [i for i, p in zip(found, plain, strict=True) if not p and i.blocks == blocks]
            rows = np.array([space[np.array(i.words) % BUCKETS].sum(0) for i in own], np.float32)
            marks = np.zeros((len(own), MARKS + 1), bool)  # words that an item can hold, by what is left of their hash
            for i, one in enumerate(own):
                marks[i, np.array(one.words) % MARKS] = True
            vectors = (rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]).T.copy()
            self.by_cosine[blocks] = own, vectors, marks, np.array([PARAPHRASE * len(i.words) for i in own])

    def _cosine(self, item: Item, own: list[int]) -> float:
        a, b = [self.space[np.array(w) % BUCKETS].sum(0) for w in (item.words, own)]
        return float(a @ b / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12))

    def find(self, texts: list[bytes | None]) -> list[list]:
        """``[(item id, share of the item, cosine, answer found)]`` of each text, every window that shares enough words verified."""
        parts = _Parts(texts)
        self._count(parts, self.groups)
        return parts.hits()

    def search(self, texts: list[bytes | None]) -> list[list]:
        """As ``find``, with candidates by cosine where the item has enough words with a direction."""
        parts = _Parts(texts)
        self._count(parts, self.by_count)
        self._near(parts)
        return parts.hits()

    def _verify(self, parts: _Parts, one: Item, doc: int, own: list[int], most: float) -> None:
        """Keep a window's hit if there is one; ``most`` words at most are shared."""
        if most < COPY * len(one.words) and not (one.answer[0] in own and one.answer[-1] in own):
            return
        share = one.share(own)
        if share < PARAPHRASE:
            return
        best = parts.seen.get((doc, id(one)))
        if best is not None and share <= best[1]:
            return
        answered = one.answered(own)
        if share >= COPY or answered:
            parts.seen[doc, id(one)] = [one.id, share, self._cosine(one, own), answered]

    def _near(self, parts: _Parts) -> None:
        if not self.by_cosine or not len(parts.words):
            return
        gap = max(self.by_cosine)  # blocks without words behind each text, so that no window reaches into the next one
        place = parts.first[:, None] + np.arange(STRIDE)
        bucket = np.append(parts.words % BUCKETS, BUCKETS)[np.where(place < parts.stops[parts.owner][:, None], place, len(parts.words))]
        real = np.arange(len(parts.first)) + parts.owner * gap
        folded = np.zeros((len(parts.first) + len(parts.sizes) * gap, self.space.shape[1]), np.float32)
        for low in range(0, len(real), ROWS):
            folded[real[low:low + ROWS]] = self.rows[bucket[low:low + ROWS]].sum(axis=1)
        window, width = folded, 1
        for blocks, (items, vectors, _, _) in self.by_cosine.items():
            for more in range(width, blocks):  # one block more at a time
                window = window[:-1] + folded[more:]
            width = blocks
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            step = max(gap, CELLS // max(len(items), len(vectors)))
            for low in range(0, len(window), step):
                high = min(low + step, len(window))
                # of windows that follow each other the one of the greatest cosine is the candidate
                wide = slice(max(0, low - 1), high + 1)
                cosine = (window[wide] @ vectors) / np.maximum(norm[wide], 1e-6)[:, None]
                cosine = np.pad(cosine, ((int(low == 0), int(high >= len(window))), (0, 0)), constant_values=-1)
                here = cosine[1:-1]
                i, j = np.nonzero((here >= NOMINATE) & (here >= cosine[:-2]) & (here >= cosine[2:]))
                block = np.minimum(np.searchsorted(real, i + low, "right"), len(real)) - 1  # a window that begins in a gap reaches the next text
                inside = block >= 0
                inside[inside] = real[block[inside]] == i[inside] + low
                block = np.where(inside, block, np.minimum(block + 1, len(real) - 1))
                for cut in range(0, len(i), PAIRS):
                    self._candidates(parts, blocks, block[cut:cut + PAIRS], j[cut:cut + PAIRS])

    def _candidates(self, parts: _Parts, blocks: int, at: np.ndarray, j: np.ndarray) -> None:
        """Verify windows around those at blocks ``at`` that can share enough words with items ``j``."""
        items, _, marks, least = self.by_cosine[blocks]
        at = np.maximum(at - 1, parts.starts[at])
        place = parts.first[at][:, None] + np.arange((blocks + 2) * STRIDE)
        word = parts.marks[np.where(place < parts.stops[parts.owner[at]][:, None], place, len(parts.words))]
        shared = np.count_nonzero(marks[j[:, None], word], axis=1)
        some = np.flatnonzero(shared >= least[j])
        for i, j, most in zip(at[some].tolist(), j[some].tolist(), shared[some].tolist(), strict=True):
            doc, own = parts.window(i, blocks + 2)
            self._verify(parts, items[j], doc, own, most)

    def _count(self, parts: _Parts, groups: dict[int, tuple]) -> None:
        words, first, starts, ends, owner = parts.words, parts.first, parts.starts, parts.ends, parts.owner
        if not len(words) or not groups:
            return
        word = self.slots[words % len(self.slots)] if self.apart else np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        known = np.flatnonzero(self.known[word] == words)
        if not len(known):
            return
        block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))[known]
        word = word[known]
        # the block behind the one of the word before it in its text: windows that begin there or later have it for the first time
        key = owner[block] * len(self.known) + word
        order = np.argsort(key, kind="stable")
        again = np.nonzero(key[order[1:]] == key[order[:-1]])[0]
        since = starts[block]
        since[order[again + 1]] = block[order[again]] + 1
        fresh = np.nonzero(since <= block)[0]
        block, word, since = block[fresh], word[fresh], since[fresh]
        at = np.arange(len(first))
        for blocks, (items, heads, item, times, least) in groups.items():
            width, many = blocks + 2, len(items)
            use = (at + width <= ends) | (at == starts)
            begin = np.maximum(since, block - width + 1)
            step = max(width, CELLS // many)
            for low in range(0, len(first), step):
                high = min(low + step, len(first))
                a, b = np.searchsorted(block, (low, high + width))
                a, b = int(a), int(b)
                from_, to = np.maximum(begin[a:b], low), np.minimum(block[a:b] + 1, high)
                part = np.nonzero(from_ < to)[0]
                of, from_, to = word[a:b][part], from_[part] - low, to[part] - low
                n = heads[of + 1] - heads[of]
                row = np.repeat(heads[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
                wide = high - low + 1
                shared = np.bincount(item[row] * wide + np.repeat(from_, n), times[row], wide * many)
                shared -= np.bincount(item[row] * wide + np.repeat(to, n), times[row], wide * many)
                shared = np.cumsum(shared.reshape(many, wide)[:, :-1], axis=1)
                j, i = np.nonzero((shared >= least[:, None]) & use[low:high])
                by_window = np.argsort(i, kind="stable")
                window = -1
                i, j = i[by_window], j[by_window]
                for i, j, most in zip(i.tolist(), j.tolist(), shared[j, i].tolist(), strict=True):
                    if i != window:  # a window's candidates come one after the other
                        window = i
                        doc, own = parts.window(low + i, width)
                    self._verify(parts, items[j], doc, own, most)


_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("answer", T.BooleanType())]))


def item_blocks(items: DataFrame, id_col: str = "item_id", text: str = "text"):
    """The items in lists that are small enough to be sent to the tasks."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator()
    held, size = [], 0
    for r in rows:
        if held and (len(held) >= ITEM_BLOCK or size + len(r["t"]) > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    if held:
        yield held


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", name: str = "hits") -> DataFrame:
    """``docs`` with an array of the items each document holds: item_id, share, cosine, answer."""
    space = fitted(docs.select(F.col(text).alias("text")), items.select("text"))
    sent = docs.sparkSession.sparkContext.broadcast(space)  # BUCKETS rows
    made = docs
    columns = []
    for number, block in enumerate(item_blocks(items)):
        column = free_name(made, f"_hits_{number}")
        columns.append(column)
        made = _with_block(made, block, sent, text, column)
    if not columns:
        return made.withColumn(name, F.array().cast(_HITS))
    return made.withColumn(name, F.concat(*columns)).drop(*columns)


def _with_block(df: DataFrame, block, sent, text: str, column: str) -> DataFrame:
    def maker():
        finder = Finder(block, sent.value)

        def work(texts):
            found, held, size = [], [], 0
            for t in texts:
                if held and size + len(t or b"") > PART:
                    found += finder.search(held)
                    held, size = [], 0
                held.append(t)
                size += len(t or b"")
            found += finder.search(held)
            return [[[dict(zip(("item_id", "share", "cosine", "answer"), h, strict=True)) for h in hits] for hits in found]]

        return work

    return annotate(df, text, [(column, _HITS)], maker).select(*[F.col(f"`{c}`") for c in df.columns], column)


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("text")
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["share"].alias("share"), (-h["item_id"]).alias("back"), h["cosine"].alias("cosine"), h["answer"].alias("answer"))))
    found = found.select("doc_id", F.size("hits").alias("n_items"), best.alias("best"), F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("items"))
    return found.select(
        "doc_id", (F.col("n_items") > 0).cast("int").alias("contaminated"), F.col("n_items").cast("long").alias("n_items"), (-F.col("best.back")).alias("item_id"),
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"), F.coalesce("best.share", F.lit(0.0)).alias("share"), F.coalesce("best.cosine", F.lit(0.0)).alias("cosine"))
