"""Field names to semantic types, and field mentions in free text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# The semantic types, in listing order.
DATA_TYPES = [
    "email", "phone", "name", "username", "password", "age", "date", "price",
    "discount_code", "url", "address", "zipcode", "credit_card", "text", "number",
]
# Ordered substring rules; the first rule with a word inside the lower-cased name decides.
NAME_RULES = [
    ("email", ["email", "mail"]),
    ("phone", ["phone", "mobile", "tel"]),
    ("username", ["user"]),
    ("name", ["name"]),
    ("password", ["password", "pwd"]),
    ("age", ["age"]),
    ("date", ["date", "dob", "birth"]),
    ("price", ["price", "cost", "amount"]),
    ("discount_code", ["discount", "promo", "coupon", "code"]),
    ("url", ["url", "website"]),
    ("address", ["address"]),
    ("zipcode", ["zip", "postal"]),
    ("credit_card", ["card", "credit"]),
    ("number", ["quantity", "count"]),
]
# Field mentions in lower-cased text, in output order.
MENTION_PATTERNS = [
    ("email", r"\b(email|e-mail|mail)\b"),
    ("phone", r"\b(phone|mobile|telephone|tel)\b"),
    ("username", r"\b(username|user[\s_]name)\b"),
    ("name", r"\b(?<!user)(name)(?![\s_])|full[\s_]name\b"),
    ("password", r"\b(password|pwd|pass)\b"),
    ("age", r"\b(age)\b"),
    ("discount_code", r"\b(discount|promo|coupon|code)\b"),
    ("price", r"\b(price|cost|amount|total)\b"),
    ("date", r"\b(date|dob|birth[\s_]date)\b"),
]
# Substrings of which every mention holds at least one (a cheap test in front of the pattern).
MENTION_HINTS = {
    "email": ["mail"], "phone": ["phone", "mobile", "tel"], "username": ["user"], "name": ["name"],
    "password": ["pass", "pwd"], "age": ["age"], "discount_code": ["discount", "promo", "coupon", "code"],
    "price": ["price", "cost", "amount", "total"], "date": ["date", "dob"],
}
# Names that describe a test case itself and never get test data.
STRUCTURE_NAMES = [
    "test_id", "feature", "test_scenario", "test_type",
    "preconditions", "test_steps", "expected_result", "source_document",
    "test_case", "scenario", "steps", "result",
]
# ----------------------------------------------------------------------------------------------

FIELD_TYPE = "struct<field_name:string,data_type:string,required:boolean,constraints:map<string,double>>"
FIELDS_TYPE = f"array<{FIELD_TYPE}>"


def _holds_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def _type_of(name: str) -> str:
    return next((kind for kind, words in NAME_RULES if any(word in name for word in words)), "text")


def detect_field_type(name: Column) -> Column:
    """Semantic type of a field name by substring rules; ``text`` when none applies.

    The rules are applied as they stand, misfires included (``zipcode`` holds ``code`` and
    ``page_id`` holds ``age``); ``detect_field_type_strict`` looks at whole words instead.
    """
    lowered = F.lower(name)
    decided = None
    for data_type, words in NAME_RULES:
        hit = _holds_any(lowered, words)
        decided = F.when(hit, F.lit(data_type)) if decided is None else decided.when(hit, F.lit(data_type))
    return decided.otherwise(F.lit("text"))


def detect_field_type_strict(name: Column) -> Column:
    """Opt-in variant: a rule word must be a whole word of the (snake or camel case) name."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    words = F.split(F.lower(spaced), r"[^\p{L}\p{N}]+")
    exact = F.array(*[F.lit(t) for t in DATA_TYPES])
    decided = F.when(F.array_contains(exact, F.lower(spaced)), F.lower(spaced))
    for data_type, rule_words in NAME_RULES:
        decided = decided.when(
            F.arrays_overlap(words, F.array(*[F.lit(w) for w in [data_type, *rule_words]])), F.lit(data_type)
        )
    return decided.otherwise(F.lit("text"))


def _no_constraints() -> Column:
    return F.create_map().cast("map<string,double>")


def extract_fields(text: Column) -> Column:
    """Field definitions mentioned in free text, as an array in a fixed order.

    The parts are concatenated rather than filtered: concatenation stays in generated code, a
    lambda would not.
    """
    lowered = F.lower(text)
    nothing = F.array().cast(FIELDS_TYPE)

    def part(name: str, pattern: str) -> Column:
        mentioned = _holds_any(lowered, MENTION_HINTS[name]) & lowered.rlike("(?U)" + pattern)
        field = F.struct(
            F.lit(name).alias("field_name"),
            F.lit(_type_of(name)).alias("data_type"),
            F.lit(True).alias("required"),
            _no_constraints().alias("constraints"),
        )
        return F.when(mentioned, F.array(field).cast(FIELDS_TYPE)).otherwise(nothing)

    return F.concat(*[part(name, pattern) for name, pattern in MENTION_PATTERNS])


def is_structure_name(name: Column) -> Column:
    return F.lower(name).isin(STRUCTURE_NAMES)


def data_fields(fields: Column) -> Column:
    """A field array without the names that only describe the test case."""
    return F.filter(fields, lambda f: ~is_structure_name(f["field_name"]))
