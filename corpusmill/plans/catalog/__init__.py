"""One registered query per operator, over the given tables as a whole."""

from corpusmill.plans.catalog import chunks, datasets, fields, pages, prompts, sources, streams, vectors  # noqa: F401
from corpusmill.plans.catalog.registry import QUERIES, TWINS  # noqa: F401
