"""Embedding columns.  Arrays may be float or double; arithmetic is always double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def unit(v: Column) -> Column:
    """Unit vector; NULL for a zero vector.

    The length is held in a lambda variable: within the lambda of the components it would be computed for each of them.
    """
    return F.get(F.transform(F.array(norm(v)), lambda length: F.when(length > 0, F.transform(_double(v), lambda x: x / length))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; NULL when a vector has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (what a flat L2 index reports as its distance)."""
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def max_distance(min_similarity: float | Column) -> float | Column:
    """Largest distance that still has ``min_similarity``; every distance has at least 0."""
    if isinstance(min_similarity, Column):
        return F.when(min_similarity <= 0, F.lit(float("inf"))).otherwise(1.0 / min_similarity - 1.0)
    return float("inf") if min_similarity <= 0 else 1.0 / min_similarity - 1.0


def require_dimension(v: Column, dimension: int) -> Column:
    """The vector as float array, failing the job on any other width."""
    message = F.concat(
        F.lit(f"embedding must have {dimension} values, got "), F.coalesce(F.size(v).cast("string"), F.lit("none"))
    )
    return F.when(F.size(v) == dimension, v.cast("array<float>")).otherwise(F.raise_error(message))
