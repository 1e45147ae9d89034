"""Documents that arrive in parts: pages, and paragraphs with table cells.

The parts of a document end up in one text, so a group is exactly as large as its result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank


def join_pages(pages: DataFrame, doc: str, page_no: str, text: str = "text") -> DataFrame:
    """One text per document: non-blank pages under their own number (from 1)."""
    entry = F.concat(F.lit("--- Page "), F.col(page_no).cast("string"), F.lit(" ---\n"), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("n"), entry.alias("entry"))))
    return pages.filter(~is_blank(F.col(text))).groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda p: p["entry"]), "\n\n").alias("text")
    )


def join_parts(parts: DataFrame, doc: str, kind: str, position: list[str], text: str = "text") -> DataFrame:
    """One text per document: non-blank parts line by line, by kind (paragraphs 0, cells 1) and position."""
    place = F.struct(*[F.col(c) for c in [kind, *position]], F.col(text).alias("_t"))
    return parts.filter(~is_blank(F.col(text))).groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["_t"]), "\n").alias("text")
    )
