"""JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_json(rows: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines below ``path``; ``by`` writes one folder per value (valid, invalid, boundary)."""
    writer = rows.write.mode(mode)
    if by is not None:
        writer = writer.partitionBy(by)
    writer.json(path)
