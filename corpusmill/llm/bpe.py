"""Byte-level BPE: whole texts to token ids and back.

A text is split by a pattern and every piece is merged on its own.  Pieces not seen before are merged
together, many at a time: a segment tree over byte positions holds the rank of the pair that starts at each
live position, its root is the leftmost smallest rank, and a merge changes three leaves (the merged position,
its live predecessor and the swallowed neighbour) with one path to the root each.  Trees of equal size lie in
one array, so a step of all of them is a few array operations.

Ranks come from a public rank file whose path is a parameter; nothing is trained here.  Each worker remembers
the ids of pieces it has met, up to a bounded number of bytes; beyond that, and between tasks, those of the texts
it has read last.

Nulls: a null text is an empty text; an empty text has no tokens.  Bytes that are not UTF-8 are read as the
replacement character.  Repeated rows and clashing other columns are kept as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, documents, once
from corpusmill.llm.registry import query

#: Bytes of pieces and their ids that one worker remembers.
MEMO_BYTES = 96 << 20
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 20
_NONE = np.int64(1 << 40)


class Merger:
    """The merges of one rank table, many pieces at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.of_byte < 0).any():
            raise ValueError("the rank table lacks single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        order = sorted(pairs)
        self.keys = np.array([*order, np.iinfo(np.int64).max], np.int64)
        self.values = np.array([*[pairs[k] for k in order], _NONE], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                groups.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            rows = max(1, (1 << 20) // width)
            for s in range(0, len(members), rows):
                part = members[s:s + rows]
                for i, ids in zip(part, self._merge_equal([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_equal(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < sizes[:, None], self.of_byte[raw], -1)
        after = np.broadcast_to(at + 1, (n, width)).copy()
        before = np.broadcast_to(at - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:2 * width - 1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def put(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves are equally deep
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(live):
            node = np.ones(len(live), np.int64)
            while node[0] < width:
                node = 2 * node
                node += tree[live, node] > tree[live, node + 1]
            left = node - width
            right = after[live, left]
            ids[live, left] = tree[live, 1]
            beyond = after[live, right]
            after[live, left] = beyond
            ids[live, right] = -1
            has = beyond < width
            before[live[has], beyond[has]] = left[has]
            put(live, right, np.full(len(live), _NONE))
            follower = np.where(has, ids[live, np.minimum(beyond, width - 1)], -1)
            put(live, left, self.pair_rank(ids[live, left], follower))
            prior = before[live, left]
            has = prior >= 0
            if has.any():
                rows, prior = live[has], prior[has]
                put(rows, prior, self.pair_rank(ids[rows, prior], ids[rows, left[has]]))
            live = live[tree[live, 1] < _NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _class_of(pattern: str) -> str:
    """A character class for ``re`` with exactly the characters that ``pattern`` matches."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    spans, last = [], None
    for c in map(ord, regex.findall(pattern, every)):
        if last is not None and c == last + 1:
            spans[-1][1] = last = c
        else:
            spans.append([c, c])
            last = c
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern; the Unicode classes are spelled out, which the plain engine runs much faster."""
    letters, numbers, spaces = _class_of(r"\p{L}"), _class_of(r"\p{N}"), _class_of(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    out = out.replace(r"(?!\S)", f"(?![^{spaces}])").replace(r"\s", f"[{spaces}]")
    if "\\p" in out or "(?i" in out:
        return regex.compile(pattern).findall
    return re.compile(out).findall


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one rank table and pattern; remembers what it has met.

    Where no space is followed by white space, every space starts a piece, so such texts are cut at
    spaces first and what stands between them (pattern pieces and all) is looked up as one.
    """

    def __init__(self, path: str, pattern: str):
        self.merger = Merger(read_ranks(path))
        self.find = splitter(pattern)
        self.spaced = re.compile(r" \s").search
        words = {rank: token for token, rank in self.merger.ranks.items()}
        self.sizes = np.array([len(words.get(i, b"")) for i in range(max(words) + 1)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(words.get(i, b"") for i in range(max(words) + 1)), np.uint8)
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.last: set[str] = set()
        self.held = 0

    def _learn(self, runs: list[str], prefix: str) -> list[bytes]:
        cut = [self.find(prefix + r) for r in runs]
        known = self.pieces
        new = list(set().union(*cut).difference(known))
        for w, ids in zip(new, self.merger.merge([w.encode() for w in new]), strict=True):
            known[w] = ids
            self.held += 160 + len(w) + len(ids)
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def rest(self) -> None:
        """Forget all but what the texts read last hold."""
        self.runs = {r: self.runs[r] for r in self.last}
        self.pieces = {w: self.pieces[w] for w in map(" ".__add__, self.last) if w in self.pieces}
        self.held = sum(160 + len(w) + len(ids) for known in (self.runs, self.pieces) for w, ids in known.items())
        if self.held > MEMO_BYTES // 2:  # a very long text
            self.pieces, self.runs, self.last, self.held = {}, {}, set(), 0

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.rest()
        plain = [(t or b"").decode("utf-8", "replace") for t in texts]
        heads, tails = [], []
        for t in plain:
            if self.spaced(t):
                heads.append(t)
                tails.append([])
            else:
                first, *rest = t.split(" ")
                heads.append(first)
                tails.append(rest)
        self.last = set().union(*tails)
        new = list(self.last.difference(self.runs))
        for run, ids in zip(new, self._learn(new, " "), strict=True):
            self.runs[run] = ids
            self.held += 160 + len(run) + len(ids)
        get = self.runs.__getitem__
        return [h + b"".join(map(get, rest)) for h, rest in zip(self._learn(heads, ""), tails, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        rows = np.frombuffer(ids, "<u4")
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.letters[at].tobytes()


def _codec(path: str, pattern: str) -> Codec:
    return once(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as little-endian unsigned 32-bit integers in a binary column."""
    return annotate(df, text, [(name, T.BinaryType())], lambda: lambda texts: [_codec(path, pattern).encode(texts)], TEXT_BYTES)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; null ids decode to nothing."""
    return annotate(df, ids, [(name, T.BinaryType())], lambda: lambda rows: [[_codec(path, pattern).decode(r or b"") for r in rows]])


def encode_digests(df: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` without its text, with the number and digest of its ids and the digest of the decoded ids, and the ids if wanted."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *[("ids", T.BinaryType())] * with_ids]

    def maker():
        codec = _codec(path, pattern)

        def work(texts):
            rows = codec.encode(texts)
            return ([len(r) // 4 for r in rows], [hashlib.sha256(r).hexdigest() for r in rows],
                    [hashlib.sha256(codec.decode(r)).hexdigest() for r in rows], *[rows] * with_ids)

        return work

    return annotate(df, text, fields, maker, TEXT_BYTES).drop(text)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
