"""Near-duplicate documents by 64-bit fingerprints and multi-index hashing.

A fingerprint has a bit set where over half of the document's shingle hashes have it.  Two
fingerprints are linked when they differ in at most four bits.  The 64 bits are cut into three
segments; of any linked pair one segment differs in at most as many bits as its radius says (1, 1,
0: the radii need to add up to ``bits - segments + 1``).  Every fingerprint therefore probes, per
segment, the small Hamming ball around its own value, meets the fingerprints filed under these
values and the complete distance decides.

Equal fingerprints are one row before anything is joined, so exact copies never meet each other.

Nulls: null text is an empty text (fingerprint zero, linked like any other); rows with a null id
take part but are named by no component unless they have no other member.  Repeated rows give
repeated result rows.  An empty table gives an empty result.  Other columns are ignored by
``op5`` and kept by ``first_of_groups``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import annotate, components, documents, free_name, text_key
from corpusmill.llm.registry import query
from corpusmill.session import materialize

#: (first bit, bits, radius) of each segment for links of up to four differing bits.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
MAX_BITS = 4
SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int32)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Bits that are set in over half of the XXH64 values of the ``width``-word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops[width - 1:])])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    n = len(table)
    value = 0
    for i in range(8):  # digests are big-endian
        counts = np.bincount(table[:, i], minlength=256) @ _BYTE_BITS
        for bit in np.nonzero(counts * 2 > n)[0].tolist():
            value |= 1 << (8 * (7 - i) + bit)
    return value


def _maker():
    def work(texts):
        values = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        return [values.tolist()]

    return work


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text and with the fingerprint as a signed long."""
    return annotate(docs, text, [(name, T.LongType())], _maker).drop(text)


def fingerprint_links(prints: DataFrame, segments=SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints of ``prints(fp)`` within ``max_bits``; may repeat a pair."""
    if sum(r for _, _, r in segments) < max_bits - len(segments) + 1 or sum(b for _, b, _ in segments) != 64:
        raise ValueError("the radii of the segments do not cover the distance")

    def value(first: int, bits: int):
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    filed = F.array(*[F.struct(F.lit(i).alias("segment"), value(first, bits).alias("value")) for i, (first, bits, _) in enumerate(segments)])
    def ball(i: int, first: int, bits: int, radius: int):
        flips = [0] if radius == 0 else [0, *[1 << b for b in range(bits)]]
        if radius > 1:
            flips += [1 << a | 1 << b for a in range(bits) for b in range(a)]
        if radius > 2:
            raise ValueError("balls of more than two bits are not built")
        values = F.array(*[F.lit(x) for x in flips]).cast("array<bigint>")
        return F.transform(values, lambda x: F.struct(F.lit(i).alias("segment"), value(first, bits).bitwiseXOR(x).alias("value")))

    probes = [ball(i, *segment) for i, segment in enumerate(segments)]
    table = prints.select(F.col("fp").alias("b"), F.explode(filed).alias("k")).select("b", "k.*")
    asked = prints.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k")).select("a", "k.*")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return asked.join(table, ["segment", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segments=SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)`` per row of ``docs``; the key tells apart rows that share an id."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    made = materialize(fingerprints(plain), "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = fingerprint_links(classes.select("fp"), segments, max_bits)
    # a class is named by its fingerprint while links are followed, as ids may be null
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "component").select("fp", "component_id")
    return made.join(labels, "fp").select("doc_id", "text_key", "fp", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of ``docs``, the one with the smallest id, with all its columns."""
    return first_rows(docs, simhash_groups(docs, id_col, text, **options), id_col, text)


def first_rows(docs: DataFrame, groups: DataFrame, id_col: str, text: str) -> DataFrame:
    """The first row of each of ``groups(doc_id, text_key, component_id)``; columns of any name stay as they are."""
    one, key, first_id, first_key = (free_name(docs, c) for c in ("_id", "_text_key", "_first_id", "_first_key"))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows that share an id and a group are told apart by their text; equal rows are one
    first = kept.groupBy(F.col("doc_id").alias(first_id)).agg(F.min("text_key").alias(first_key))
    keyed = docs.withColumns({one: F.col(f"`{id_col}`").cast("long"), key: text_key(F.col(f"`{text}`"))})
    found = keyed.join(first, F.col(one).eqNullSafe(F.col(first_id)) & (F.col(key) == F.col(first_key))).drop(first_id, first_key)
    return found.dropDuplicates([one, key]).drop(one, key)


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
