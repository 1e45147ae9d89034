"""Mixing sources to target weights: whole documents that fill each source's budget of words.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share one and a half times all words.  A
target above twice its source's size stops there, and the excess goes to the others by weight until none is above.

Every document is taken ``target // source size`` times (0, 1 or 2).  What remains is a subset-sum budget:
documents are counted by exact length; longest first, each length gives the share of its documents that the
budget asks for, with what is left over carried to the next length, until about ``EXACT`` words remain; a
bounded-knapsack program over the lengths and the documents still free then finds the sum nearest to the rest (a
source of fewer words is settled by it alone).  Which documents of a length are taken once more is decided by a
seeded hash of the id, so reruns agree and no part of the table is preferred.

Texts are read once, for their length.  The rest works on ids: a histogram of (source, length, hash bucket), one
row per source and length for the program, and ranks inside the one bucket per length in which the taken documents
end.  A source, or a length that a third of all documents share, is thus split over ``BUCKETS`` keys, and rows of
one id are counted before they are ranked.

Defined cases: a null text has length 0 and is taken 0 times, as is an empty one; a null id is an id; repeated
rows are rows of their own, of which some may be taken more often; documents of equal hash go by id.  A source
without words has target 0.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.registry import query
from corpusmill.operators.positions import with_position
from corpusmill.session import materialize, read_table

# --- fixed values -----------------------------------------------------------------------------
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
# ----------------------------------------------------------------------------------------------
EXACT = 1 << 16
LARGEST = 1 << 22  # sums that the program can hold
BUCKETS = 1024
SEED = 29


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """``(doc_id, source, size, rows)``: equal ids of one source and size once, with their number; written once."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), words.alias("size"))
    return materialize(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sized")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``sizes(source, source_size)``."""
    placed = with_position(sizes.where(F.col("source").isNotNull()), "source", "_place")
    last = sizes.where(F.col("source").isNull()).withColumn("_place", F.lit(sizes.where(F.col("source").isNotNull()).count()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = materialize(placed.unionByName(last).select("source", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * most
    whole, all_weights, n = table.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    if not n:
        return table.withColumn("target", F.lit(0.0))
    budget, level, stopped = share * whole, share * whole / all_weights, 0
    while True:  # the level only rises, and each round stops another source or ends
        full = F.col("weight") * level > limit
        held, rest, now = table.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full)).first()
        if now == stopped or not rest:
            break
        level, stopped = (budget - held) / rest, now
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double")))


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each length to take so that their words come nearest to ``budget`` (bounded knapsack)."""
    taken = np.zeros(len(lengths), np.int64)
    size = min(int(2 * budget) + 1, int((lengths * counts).sum()))  # beyond twice the budget nothing beats taking none
    if budget <= 0 or size <= 0:
        return taken
    first = np.full(size + 1, -1, np.int32)  # the length by which a sum is first reached
    first[0] = len(lengths)
    reached = np.zeros(size + 1, bool)
    reached[0] = True
    goal = round(budget)
    for i, (length, free) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        before, left, step = reached.copy(), min(free, size // length), 1
        while left > 0:  # 1, 2, 4, ... and the rest give every number of copies
            jump = min(step, left) * length
            if jump <= size:
                reached[jump:] |= reached[:-jump].copy()
            left, step = left - min(step, left), step * 2
        first[reached & ~before] = i
        if goal <= size and reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i = int(first[at])
        copies = 1
        # reached by this length first, so with some number of its copies the rest was reached before it
        while first[at - copies * lengths[i]] != len(lengths) and not 0 <= first[at - copies * lengths[i]] < i:
            copies += 1
        taken[i] += copies
        at -= copies * int(lengths[i])
    return taken


def fill(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Documents of each length (``lengths`` falling, each with its count) that fill ``budget`` words."""
    taken = np.zeros(len(lengths), np.int64)
    bulk, words = budget - EXACT, float((lengths * counts).sum())
    if bulk > 0 and words > 0:
        share, carried = bulk / words, 0.0
        for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
            wanted = carried + length * count * share
            taken[i] = min(count, int(wanted // length))
            carried = wanted - taken[i] * length
    rest = budget - float((lengths * taken).sum())
    for i, length in enumerate(lengths.tolist()):  # only where documents are longer than the program can hold
        if rest <= LARGEST:
            break
        more = min(int(counts[i] - taken[i]), int(rest // length))
        taken[i], rest = taken[i] + more, rest - more * length
    # shortest first: the nearest sum is mostly reached by few lengths
    order = np.arange(len(lengths))[::-1]
    taken[order] += nearest_sum(lengths[order], (counts - taken)[order], rest)
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of all documents of each size (``base``) and how many of them once more, for one source."""
    pdf = pdf.sort_values("size", ascending=False)
    whole, target = float(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    words = (pdf["size"] > 0).to_numpy()
    base = int(target // whole) if whole else 0
    more = np.zeros(len(pdf), np.int64)
    more[words] = fill(pdf["size"].to_numpy(np.int64)[words], pdf["n"].to_numpy(np.int64)[words], target - base * whole)
    return pdf.drop(columns="n").assign(base=base, more=more)


def mixed(docs: DataFrame, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per row of ``docs``."""
    rows = sized(docs).withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_bucket", F.pmod(F.col("_draw"), F.lit(BUCKETS)).cast("int"))
    # the null source needs a key that joins
    rows = rows.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    key = ["_none", "_source"]
    histogram = materialize(rows.groupBy(*key, "size", "_bucket").agg(F.sum("rows").alias("n")), "histogram")
    lengths = histogram.groupBy(*key, "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources.select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size"), share, most)
    aims = aims.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    plan = lengths.join(aims, key).groupBy(*key).applyInPandas(
        _plan, "_none boolean, _source string, size long, source_size long, target double, base int, more long")
    # buckets are taken whole until the one in which the wanted number ends
    bucket = Window.partitionBy(*key, "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = histogram.join(plan, [*key, "size"]).withColumn("_want", F.col("more") - (F.sum("n").over(bucket) - F.col("n"))).drop("n", "more")
    inside = Window.partitionBy(*key, "size", "_bucket").orderBy("_draw", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    chosen = rows.join(ends, [*key, "size", "_bucket"]).withColumn("_want", F.col("_want") - (F.sum("rows").over(inside) - F.col("rows")))
    one = chosen.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = F.col("size") * (F.col("base") + (F.col("_nth") <= F.col("_want")).cast("int"))
    return one.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


@query("op11_source_mix")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return made.select("doc_id", "size", "source_size", "target", "taken", "source")
