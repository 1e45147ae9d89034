"""Global row positions without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 200_000
MAX_RANGES = 16_384
SAMPLE_PER_RANGE = 8
EDGES_PER_GROUP = 128


def with_position(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the 0-based position of each row in ``key`` order (``key`` unique and not null).

    The key space is cut at a few sampled values.  They decide the balance only, never the
    result: rows are numbered inside their range, and each range is shifted by the number of
    rows before it.  Only the cut values and one count per range pass through the driver.
    """
    spark = df.sparkSession
    n_rows = df.select(key).count()
    n_ranges = max(1, min(MAX_RANGES, -(-n_rows // ROWS_PER_RANGE)))
    cuts = _cuts(df, key, n_rows, n_ranges)
    if not cuts:
        order = Window.partitionBy(F.lit(0)).orderBy(key)
        return df.withColumn(name, (F.row_number().over(order) - 1).cast("bigint"))
    located = df.withColumn("_range", _range_of(F.col(key), cuts))
    sizes = dict(located.groupBy("_range").count().collect())  # at most MAX_RANGES rows
    starts, before = [], 0
    for r in range(len(cuts) + 1):
        starts.append((r, before))
        before += sizes.get(r, 0)
    offsets = spark.createDataFrame(starts, "_range int, _start bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (
        located.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_start")
    )


def _range_of(key: Column, cuts: list) -> Column:
    """Number of cuts at or below the key, looked up in two steps to keep it cheap per row."""
    groups = [cuts[i:i + EDGES_PER_GROUP] for i in range(0, len(cuts), EDGES_PER_GROUP)]
    edges = F.array(*[F.array(*[F.lit(c) for c in group]) for group in groups])
    group = F.size(F.filter(edges, lambda g: g[0] <= key))
    inside = F.size(F.filter(F.get(edges, group - 1), lambda e: e <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * EDGES_PER_GROUP + inside)


def _cuts(df: DataFrame, key: str, n_rows: int, n_ranges: int) -> list:
    if n_ranges == 1:
        return []
    wanted = n_ranges * SAMPLE_PER_RANGE
    sample = df.select(key).sample(fraction=min(1.0, 1.5 * wanted / n_rows), seed=7).limit(3 * wanted)
    values = sorted(row[0] for row in sample.collect())
    step = max(1, len(values) // n_ranges)
    return sorted(set(values[step::step]))
