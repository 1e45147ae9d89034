"""Prompt columns (our own wording) and chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_TEST_CASES = (
    "You write test cases from documentation. Answer with one JSON array; every entry has the keys test_id, "
    "feature, test_scenario, test_type (positive or negative), preconditions (list), test_steps (list), "
    "expected_result and source_document. Use nothing that the documentation does not support."
)
SYSTEM_SCRIPT = (
    "You write browser test scripts in Python. Use the selectors of the page structure, wait explicitly and "
    "assert the expected result. Answer with code only."
)
SYSTEM_EXPLAIN = "You explain test cases in plain words."
SYSTEM_FIELDS = (
    "You list the input fields that a test case needs data for, never the parts of the test case itself. Answer "
    "with one JSON array of objects with the keys field_name, data_type, required and constraints."
)


def test_case_prompt(context: Column, feature: Column) -> Column:
    return F.concat(
        F.lit("Documentation:\n"), context, F.lit("\n\nFeature under test: "), feature,
        F.lit("\n\nWrite three to five test cases for this feature as a JSON array."),
    )


def script_prompt(test_case: Column, page_structure: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Test case:\n"), test_case, F.lit("\n\nPage structure:\n"), page_structure,
        F.lit("\n\nDocumentation:\n"), context, F.lit("\n\nWrite the complete script."),
    )


def explain_prompt(test_case: Column) -> Column:
    return F.concat(F.lit("Say in plain words what this test case checks:\n"), test_case)


def grounded_prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Answer from this documentation only:\n"), context, F.lit("\n\nQuestion: "), question,
    )


def fields_prompt(test_case: Column) -> Column:
    return F.concat(F.lit("Test case:\n"), test_case, F.lit("\n\nList its input fields."))


def all_cases_query(feature: Column) -> Column:
    """Retrieval query that asks for every case of a feature."""
    return F.concat(F.lit("All positive and negative test cases for "), feature)


def messages(system: Column | str, user: Column) -> Column:
    """Two-message chat: system, then user."""
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
