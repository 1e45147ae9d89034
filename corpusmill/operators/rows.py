"""Array entries to rows, and batches of rows to Python in small runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose Python values are in memory at once.
SLICE_BYTES = 1 << 20


def unnest(df: DataFrame, keep: list, array: Column, position: str, value: str) -> DataFrame:
    """One row per entry of ``array`` next to ``keep``; empty and NULL arrays give none.

    A plain explode makes the optimizer test ``size(array) > 0`` in front of it, which computes an
    expensive array several times per row.  The outer form computes it once; its row for an empty
    array is dropped afterwards.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return exploded.filter(F.col(position).isNotNull())


def in_slices(columns: list[pa.Array], kind: pa.DataType, work: Callable[..., Iterable], limit: int = SLICE_BYTES) -> pa.Array:
    """``work(*columns)`` over runs of rows as Python lists, each run about ``limit`` bytes of the first column or one row.

    A batch from Spark holds tens of megabytes of text, and Python values made of it many times that; only those of one
    run exist at once.
    """
    sizes = pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype("int64")
    part = (sizes.cumsum() - sizes) // limit
    cuts = [0, *(part[1:] != part[:-1]).nonzero()[0] + 1, len(part)]
    made = [pa.array(work(*(c.slice(a, b - a).to_pylist() for c in columns)), kind) for a, b in zip(cuts, cuts[1:]) if a < b]
    return pa.concat_arrays(made) if made else pa.array([], kind)
