"""Model responses: fence removal and JSON parsing (NULL or a status instead of an exception)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.fieldtypes import FIELDS_TYPE
from corpusmill.functions.text import strip

TEST_CASE_TYPE = (
    "struct<test_id:string,feature:string,test_scenario:string,test_type:string,preconditions:array<string>,"
    "test_steps:array<string>,expected_result:string,source_document:string>"
)


def strip_fences(response: Column) -> Column:
    """Response without its code fence marks."""
    unmarked = F.regexp_replace(strip(response), "```json\n?", "")
    return F.regexp_replace(unmarked, "```\n?", "")


def _is_array(text: Column) -> Column:
    """Whether the whole text is one JSON array and nothing else.

    The built-in parsers ignore what follows the first value.  Trailing text cannot be valid both
    as the end of an object and as the end of an array, so the text is tried inside either.
    """
    trimmed = strip(text)
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), trimmed, F.lit("}"))).isNotNull()
    in_array = F.json_array_length(F.concat(F.lit("["), trimmed, F.lit("]"))) == 1
    return F.coalesce(F.startswith(trimmed, F.lit("[")) & in_object & in_array, F.lit(False))


def parse_fields(clean: Column) -> Column:
    """Field definitions of a response without fences, NULL unless it is one JSON array."""
    read = F.from_json(clean, FIELDS_TYPE.replace("map<string,double>", "map<string,string>"))
    # constraints that are no number do not take the numeric ones with them
    numbers = lambda m: F.map_filter(F.transform_values(m, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    fields = F.transform(read, lambda f: f.withField("constraints", numbers(f["constraints"])))
    return F.when(_is_array(clean), fields.cast(FIELDS_TYPE))


def parse_cases(response: Column) -> Column:
    """Test cases of a response, NULL unless it is one JSON array."""
    return F.when(_is_array(response), F.from_json(response, f"array<{TEST_CASE_TYPE}>"))


def parse_status(response: Column) -> Column:
    """``parsed`` for a filled array, ``empty`` for an empty one, ``raw`` for anything else."""
    cases = parse_cases(response)
    return F.when(F.size(cases) > 0, "parsed").when(F.size(cases) == 0, "empty").otherwise("raw")


def clean_script(response: Column) -> Column:
    """First fenced body when the response starts with a fence, else the response."""

    def body(mark: str) -> Column:
        return strip(F.substring_index(F.get(F.split(response, mark), F.lit(1)), "```", 1))

    return (
        F.when(F.startswith(response, F.lit("```python")), body("```python"))
        .when(F.startswith(response, F.lit("```")), body("```"))
        .otherwise(response)
    )
