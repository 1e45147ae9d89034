"""Request checks: rule columns in place of request models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
MIN_LENGTHS = {
    "feature_description": 10, "feature_name": 3, "test_case": 20, "data_test_case": 10, "text": 10,
}
RANGES = {
    "top_k": (1, 20), "script_top_k": (1, 10), "num_valid": (1, 50), "num_invalid": (0, 50),
    "num_valid_per_case": (1, 20), "num_invalid_per_case": (0, 20),
}
# ----------------------------------------------------------------------------------------------


def long_enough(rule: str, value: Column) -> Column:
    return F.coalesce(F.length(value) >= MIN_LENGTHS[rule], F.lit(False))


def in_range(rule: str, value: Column) -> Column:
    low, high = RANGES[rule]
    return F.coalesce(value.between(low, high), F.lit(False))


def check_requests(requests: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations`` (names of broken rules, in rule order) and ``accepted``."""
    broken = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()]))
    return requests.withColumn("violations", broken).withColumn("accepted", F.size("violations") == 0)
