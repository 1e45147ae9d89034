"""Test values per semantic type: valid, invalid and boundary, as column expressions.

Every function takes :class:`~corpusmill.functions.draws.Draws`, so a value depends only on the
seed, the record and the field, never on partitions or run order.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.draws import Draws, entry_of

# Pools for valid values (our own; only their sizes matter).
FIRST_NAMES = [
    "Ada", "Bruno", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kira",
    "Leon", "Mira", "Nils", "Olga", "Pavel", "Quinn", "Rosa", "Sven", "Tara", "Umar", "Vera",
]
LAST_NAMES = [
    "Abbot", "Becker", "Castro", "Dahl", "Evans", "Fischer", "Grant", "Holm", "Ivanov", "Jansen",
    "Keller", "Lund", "Moreau", "Novak", "Okafor", "Petrov", "Quist", "Rossi", "Silva", "Turner",
]
MAIL_DOMAINS = [
    "mailbox.test", "post.example", "inbox.example", "letters.test",
    "office.example", "team.test", "corp.example", "home.test",
]
STREETS = [
    "Birch Way", "Canal St", "Dock Rd", "Forge Ln", "Garden Ave",
    "Harbor Dr", "Mill Rd", "North St", "Orchard Ave", "Quarry Ln",
]
CITIES = [
    "Albany", "Boise", "Camden", "Denver", "Eugene", "Fargo", "Galena", "Helena", "Irvine", "Juneau",
]
STATES = ["AK", "CO", "ID", "IL", "MT", "ND", "NJ", "OR", "UT", "VT"]
SITES = ["shop.example", "docs.example", "news.test", "wiki.test"]
WORDS = [
    "amber", "basil", "cedar", "delta", "ember", "fjord",
    "grove", "haven", "ivory", "jetty", "knoll", "larch",
]

# --- fixed values -----------------------------------------------------------------------------
SYMBOLS = "!@#$%^&*"
CODE_PREFIXES = ["SAVE", "DISCOUNT", "DEAL", "PROMO", "OFFER"]
CODE_NUMBERS = ["10", "20", "50", "100"]
PROTOCOLS = ["https://", "http://"]
PATHS = ["", "/page", "/products", "/api/v1"]
INVALID_TEXTS = {
    "email": [
        "invalid-email", "missing@domain", "@nodomain.com", "no-at-sign.com",
        "double@@domain.com", "spaces in@email.com", "",
    ],
    "phone": ["123-456-789", "000-000-0000", "phone-number", "12345", ""],
    "name": ["123", "A", "Test User!@#", "", "VeryLongNameThatExceedsReasonableLimitsForAPersonName" * 3],
    "username": ["ab", "user name", "user@name", "", "a" * 100],
    "password": ["123", "password", "12345678", "abcdefgh", ""],
    "date": ["2024-13-01", "2024-02-30", "99-99-9999", "not-a-date", "", "2024/02/30"],
    "discount_code": ["EXPIRED", "INVALID_CODE", "USED_CODE", "", "CODE_WITH_SPACES", "123"],
    "url": ["not-a-url", "ftp://invalid", "http://", "", "javascript:alert('xss')"],
    "address": ["123", "", "Invalid Address", "!@#$%"],
    "zipcode": ["123", "ABCDE", "00000", "", "999999"],
    "credit_card": ["1234-5678-9012-3456", "0000 0000 0000 0000", "1234", "", "abcd efgh ijkl mnop"],
    "text": ["", "a", "x" * 1000, "<script>alert('xss')</script>", "Text with\nnewlines\nand\ttabs"],
}
INVALID_AGES = [-5, 0, 150, 999]
INVALID_PRICES = [-10.50, 0.0, 0.001, 9999999.99]
INVALID_NUMBERS = [-999, 0]
# Default bounds and the constraint names that override them.  A range may be given under its
# long or its short name for every purpose.
DEFAULT_BOUNDS = {"age": (18, 100), "price": (1.0, 1000.0), "number": (1, 100)}
BOUND_NAMES = {
    "age": (["min_age", "min"], ["max_age", "max"]),
    "price": (["min_price", "min"], ["max_price", "max"]),
    "number": (["min_val", "min"], ["max_val", "max"]),
}
TEXT_LENGTH = (10, 100)
TEXT_BOUNDARY_LENGTH = (1, 100)
# ----------------------------------------------------------------------------------------------

PASSWORD_CHARS = string.ascii_letters + string.digits + SYMBOLS
BOUNDARY_TYPE = "array<struct<value:string,case_label:string,is_invalid:boolean>>"


def _given(constraints: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(constraints, F.lit(n)) for n in names])


def _range(constraints: Column | None, names: tuple[list[str], list[str]], defaults: tuple[float, float]) -> tuple[Column, Column]:
    """Lower and upper bound.

    Where only one is given, the other's default gives way to it; where both are given and leave
    nothing between them, both are NULL, and so is every value drawn from them.
    """
    low, high = (F.lit(float(d)) for d in defaults)
    if constraints is None:
        return low, high
    own_low, own_high = (_given(constraints, n) for n in names)
    low = F.coalesce(own_low, F.least(low, own_high))
    high = F.coalesce(own_high, F.greatest(high, own_low))
    return F.when(low <= high, low), F.when(low <= high, high)


def bounds(data_type: str, constraints: Column | None) -> tuple[Column, Column]:
    return _range(constraints, BOUND_NAMES[data_type], DEFAULT_BOUNDS[data_type])


def _text_lengths(constraints: Column | None, defaults: tuple[int, int]) -> tuple[Column, Column]:
    low, high = _range(constraints, (["min_length"], ["max_length"]), defaults)
    return low.cast("int"), high.cast("int")


def valid_email(d: Draws) -> Column:
    return F.concat(
        F.lower(d.pick(0, FIRST_NAMES)), F.lit("."), F.lower(d.pick(1, LAST_NAMES)),
        d.between(2, 1, 999).cast("string"), F.lit("@"), d.pick(3, MAIL_DOMAINS),
    )


def valid_phone(d: Draws) -> Column:
    area, prefix, line = (
        d.between(slot, low, high).cast("string")
        for slot, low, high in [(0, 200, 999), (1, 200, 999), (2, 1000, 9999)]
    )
    style = d.between(3, 0, 2)
    return (
        F.when(style == 0, F.concat(F.lit("("), area, F.lit(") "), prefix, F.lit("-"), line))
        .when(style == 1, F.concat_ws("-", area, prefix, line))
        .otherwise(F.concat(F.lit("+1"), area, prefix, line))
    )


def valid_name(d: Draws) -> Column:
    return F.concat_ws(" ", d.pick(0, FIRST_NAMES), d.pick(1, LAST_NAMES))


def valid_username(d: Draws) -> Column:
    return F.concat(
        F.lower(d.pick(0, FIRST_NAMES)), d.pick(2, ["", "_", "."]), d.between(1, 100, 9999).cast("string")
    )


def _char(bits: Column, chars: str) -> Column:
    return F.substring(F.lit(chars), (F.pmod(bits, F.lit(len(chars))) + 1).cast("int"), F.lit(1))


def valid_password(d: Draws) -> Column:
    """8 to 16 characters, one of each class first, the rest from all classes."""
    rest = d.many(5, d.between(0, 8, 16), lambda bits: _char(bits, PASSWORD_CHARS))
    return F.concat(
        _char(d.bits(1), string.ascii_uppercase), _char(d.bits(2), string.ascii_lowercase),
        _char(d.bits(3), string.digits), _char(d.bits(4), SYMBOLS), F.array_join(rest, ""),
    )


def valid_age(d: Draws, constraints: Column | None = None) -> Column:
    low, high = bounds("age", constraints)
    return d.between(0, low.cast("bigint"), high.cast("bigint"))


def valid_number(d: Draws, constraints: Column | None = None) -> Column:
    low, high = bounds("number", constraints)
    return d.between(0, low.cast("bigint"), high.cast("bigint"))


def valid_price(d: Draws, constraints: Column | None = None) -> Column:
    low, high = (F.round(b * 100).cast("bigint") for b in bounds("price", constraints))
    return d.between(0, low, high) / F.lit(100.0)


def valid_date(d: Draws, as_of: Column | None = None) -> Column:
    """A day of the last year as text; ``as_of`` makes the run repeatable."""
    today = F.current_date() if as_of is None else as_of
    return F.date_format(F.date_sub(today, d.between(0, 0, 365).cast("int")), "yyyy-MM-dd")


def valid_discount_code(d: Draws) -> Column:
    return F.concat(d.pick(0, CODE_PREFIXES), d.pick(1, CODE_NUMBERS))


def valid_url(d: Draws) -> Column:
    return F.concat(d.pick(0, PROTOCOLS), d.pick(1, SITES), d.pick(2, PATHS))


def valid_address(d: Draws) -> Column:
    return F.concat(
        d.between(0, 100, 9999).cast("string"), F.lit(" "), d.pick(1, STREETS), F.lit(", "), d.pick(2, CITIES),
        F.lit(", "), d.pick(3, STATES), F.lit(" "), d.between(4, 10000, 99999).cast("string"),
    )


def valid_zipcode(d: Draws) -> Column:
    return d.between(0, 10000, 99999).cast("string")


def valid_credit_card(d: Draws) -> Column:
    groups = [d.between(0, 4000, 4999), *[d.between(slot, 1000, 9999) for slot in (1, 2, 3)]]
    return F.concat_ws(" ", *[g.cast("string") for g in groups])


def valid_text(d: Draws, constraints: Column | None = None) -> Column:
    """Words cut to a drawn length; only the maximum length is guaranteed."""
    low, high = _text_lengths(constraints, TEXT_LENGTH)
    length = d.between(0, low.cast("bigint"), high.cast("bigint")).cast("int")
    n_words = F.floor(length / 5).cast("bigint")
    words = d.many(1, F.greatest(n_words, F.lit(1).cast("bigint")), lambda bits: entry_of(WORDS, bits))
    return F.when(n_words > 0, F.substring(F.array_join(words, " "), F.lit(1), length)).otherwise("")


def _outside(values: list, low: Column, high: Column, kind: str) -> Column:
    """Fixed bad numbers that are bad for this range, never an empty pool."""
    fixed = F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    below = F.array(low - 1).cast(f"array<{kind}>")
    above = F.array(high + 1).cast(f"array<{kind}>")
    outside = F.filter(fixed, lambda v: (v < low) | (v > high))
    if kind == "double":
        return F.when(F.size(outside) > 0, outside).otherwise(below)
    return F.concat(below, above, outside)


def invalid_age(d: Draws, constraints: Column | None = None) -> Column:
    low, high = bounds("age", constraints)
    return d.pick(0, _outside(INVALID_AGES, low, high, "bigint"))


def invalid_number(d: Draws, constraints: Column | None = None) -> Column:
    low, high = bounds("number", constraints)
    return d.pick(0, _outside(INVALID_NUMBERS, low, high, "bigint"))


def invalid_price(d: Draws, constraints: Column | None = None) -> Column:
    low, high = bounds("price", constraints)
    return d.pick(0, _outside(INVALID_PRICES, low, high, "double"))


def invalid_text_value(data_type: str, d: Draws) -> Column:
    return d.pick(0, INVALID_TEXTS[data_type])


def typed_value(
    data_type: str,
    d: Draws,
    valid: bool = True,
    constraints: Column | None = None,
    as_of: Column | None = None,
) -> Column:
    """The value of one known type in its own column type."""
    if not valid and data_type in INVALID_TEXTS:
        return invalid_text_value(data_type, d)
    if data_type in BOUND_NAMES:
        makers = {
            "age": (valid_age, invalid_age), "number": (valid_number, invalid_number),
            "price": (valid_price, invalid_price),
        }
        return makers[data_type][0 if valid else 1](d, constraints)
    if data_type == "date":
        return valid_date(d, as_of)
    if data_type == "text":
        return valid_text(d, constraints)
    return {
        "email": valid_email, "phone": valid_phone, "name": valid_name, "username": valid_username,
        "password": valid_password, "discount_code": valid_discount_code, "url": valid_url,
        "address": valid_address, "zipcode": valid_zipcode, "credit_card": valid_credit_card,
    }[data_type](d)


def field_value(
    data_type: Column, valid: Column, d: Draws, constraints: Column | None = None, as_of: Column | None = None
) -> Column:
    """The value of a type held in a column, as text; an unknown type is treated as ``text``."""
    chosen = None
    for known in ["email", "phone", "name", "username", "password", "age", "date", "price", "discount_code",
                  "url", "address", "zipcode", "credit_card", "number"]:
        value = F.when(valid, typed_value(known, d, True, constraints, as_of).cast("string")).otherwise(
            typed_value(known, d, False, constraints, as_of).cast("string")
        )
        match = data_type == known
        chosen = F.when(match, value) if chosen is None else chosen.when(match, value)
    return chosen.otherwise(
        F.when(valid, valid_text(d, constraints)).otherwise(invalid_text_value("text", d))
    )


def boundary_cases(data_type: Column, constraints: Column | None = None) -> Column:
    """Boundary values of a field as an array of structs; empty for types without a range."""

    def case(value: Column, label: str, invalid: bool = False) -> Column:
        return F.struct(
            value.cast("string").alias("value"), F.lit(label).alias("case_label"), F.lit(invalid).alias("is_invalid")
        )

    youngest, oldest = (b.cast("bigint") for b in bounds("age", constraints))
    cheapest, dearest = bounds("price", constraints)
    shortest, longest = _text_lengths(constraints, TEXT_BOUNDARY_LENGTH)
    letters = lambda n: F.repeat(F.lit("a"), n)
    return (
        F.when(data_type == "age", F.array(
            case(youngest, "minimum_age"), case(oldest, "maximum_age"),
            case(youngest - 1, "below_minimum", True), case(oldest + 1, "above_maximum", True),
        ))
        .when(data_type == "price", F.array(
            case(cheapest, "minimum_price"), case(dearest, "maximum_price"),
            case(F.lit(0.01), "very_small_price"), case(F.lit(-1.0), "negative_price", True),
        ))
        .when(data_type == "text", F.array(
            case(letters(shortest), "minimum_length"), case(letters(longest), "maximum_length"),
            case(F.lit(""), "empty_string", True), case(letters(longest + 1), "exceeds_maximum", True),
        ))
        .otherwise(F.array().cast(BOUNDARY_TYPE))
    )
