"""Operators for training-data pipelines, one module each, with their queries and SQL twins."""

from corpusmill.llm import bpe, cap_filters, chat, decontamination, languages, licenses, mixing, negatives, quality, repair, runs, simhash, toxicity  # noqa: F401
from corpusmill.llm.registry import QUERIES, TWINS  # noqa: F401
