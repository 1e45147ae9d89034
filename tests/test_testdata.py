import datetime
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fieldtypes as ft
from corpusmill.functions import generators as gen
from corpusmill.functions.draws import Draws
from corpusmill.operators import datasets as ds

SHAPES = {
    "email": r"[a-z]+\.[a-z]+[1-9]\d{0,2}@[a-z.]+", "phone": r"\([2-9]\d\d\) [2-9]\d\d-\d{4}|[2-9]\d\d-[2-9]\d\d-\d{4}|\+1[2-9]\d\d[2-9]\d\d\d{4}",
    "name": r"[A-Z][a-z]+ [A-Z][a-z]+", "username": r"[a-z]+[_.]?\d{3,4}",
    "password": r"[A-Z][a-z]\d[!@#$%^&*][A-Za-z0-9!@#$%^&*]{4,12}", "date": r"\d{4}-\d\d-\d\d",
    "discount_code": r"(SAVE|DISCOUNT|DEAL|PROMO|OFFER)(10|20|50|100)", "url": r"https?://[a-z.]+(/page|/products|/api/v1)?",
    "address": r"\d{3,4} [A-Z][a-z]+ \w+, [A-Z][a-z]+, [A-Z]{2} \d{5}", "zipcode": r"[1-9]\d{4}",
    "credit_card": r"4\d{3}( [1-9]\d{3}){3}", "text": r"[a-z ]{0,100}",
}


def values(spark, kind, valid, constraints=None, n=400):
    limits = None if constraints is None else F.create_map(*[F.lit(x) for kv in constraints.items() for x in (kv[0], float(kv[1]))])
    draws = Draws(1, F.col("id"), F.lit(kind))
    return [r[0] for r in spark.range(n).select(gen.typed_value(kind, draws, valid, limits, F.lit("2024-03-01").cast("date"))).collect()]


@pytest.mark.parametrize("kind", list(SHAPES))
def test_valid_texts_have_their_shape(spark, kind):
    got = values(spark, kind, True)
    assert all(re.fullmatch(SHAPES[kind], v) for v in got)
    assert len(set(got)) > 10
    if kind == "date":
        days = [(datetime.date(2024, 3, 1) - datetime.date.fromisoformat(v)).days for v in got]
        assert min(days) >= 0 and max(days) <= 365


@pytest.mark.parametrize("kind", list(gen.INVALID_TEXTS))
def test_invalid_texts_cover_their_pool(spark, kind):
    assert set(values(spark, kind, False)) == set(gen.INVALID_TEXTS[kind])


def test_number_ranges(spark):
    assert set(values(spark, "age", True, {"min": 20, "max": 22})) == {20, 21, 22}
    assert set(values(spark, "age", True, {"min_age": 30, "max_age": 31})) == {30, 31}
    assert set(values(spark, "age", False)) == {17, 101, -5, 0, 150, 999}
    assert set(values(spark, "age", False, {"min": 0, "max": 150})) == {-1, 151, -5, 999}
    assert set(values(spark, "number", False)) == {0, 101, -999}
    assert set(values(spark, "price", False)) == {-10.5, 0.0, 0.001, 9999999.99}
    assert set(values(spark, "price", False, {"min": -100, "max": 1e9})) == {-101.0}
    prices = values(spark, "price", True, {"min_price": 2, "max_price": 3})
    assert min(prices) >= 2 and max(prices) <= 3 and all(round(p, 2) == p for p in prices)
    assert max(len(t) for t in values(spark, "text", True, {"min_length": 1, "max_length": 30})) <= 30


@pytest.mark.parametrize("name,kind,strict", [
    ("email_address", "email", "email"), ("hotel", "phone", "text"), ("userName", "username", "username"), ("zipcode", "discount_code", "zipcode"),
    ("page_id", "age", "text"), ("country", "number", "text"), ("update", "date", "text"), ("card_number", "credit_card", "credit_card"),
    ("postal_code", "discount_code", "discount_code"), ("first_name", "name", "name"), ("colour", "text", "text"), ("BIRTH", "date", "date"),
])
def test_field_names(spark, name, kind, strict):
    row = spark.createDataFrame([(name,)], "n string").select(
        ft.detect_field_type(F.col("n")).alias("k"), ft.detect_field_type_strict(F.col("n")).alias("s")).first()
    assert (row.k, row.s) == (kind, strict)


TEXTS = {
    "Type your e-mail and full name": ["email", "name"], "Name: Bob, tel 5": ["phone", "name"], "my name is": [],
    "user name and password": ["username", "password"], "username": ["username"], "the total cost on that date": ["price", "date"],
    "Use promo code at age 30": ["age", "discount_code"], "rename the page": [], "name": ["name"], "nameé": [], "nothing": [],
}


def test_field_mentions_equal_python_search(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", ft.extract_fields(F.col("t")).alias("f")).collect()
    for row in rows:
        by_python = [n for n, p in ft.MENTION_PATTERNS if re.search(p, row.t.lower())]
        assert [f.field_name for f in row.f] == by_python, row.t
        if row.t != "nameé":
            assert by_python == TEXTS[row.t], row.t
        assert all(f.required and f.constraints == {} for f in row.f)


def cases(spark):
    rows = [
        (1, [("email", "email", True, {}), ("age", "age", True, {"min": 21.0, "max": 60.0}), ("note", "text", False, {"max_length": 5.0})]),
        (2, []), (3, [("cost", None, True, {})]), (4, [("odd", "mystery", True, {})]),
    ]
    return spark.createDataFrame(rows, f"case_id bigint, fields {ft.FIELDS_TYPE}")


def test_record_sets(spark):
    rows = ds.records(cases(spark), 4, 5, seed=3).collect()
    assert {r.case_id for r in rows} == {1, 3, 4}
    valid = [r for r in rows if r.kind == "valid" and r.case_id == 1]
    assert len(valid) == 12 and not any(r.is_invalid for r in valid)
    for n in range(5):
        record = sorted((r for r in rows if r.kind == "invalid" and r.case_id == 1 and r.record_id == n), key=lambda r: r.pos)
        assert [r.is_invalid for r in record] == [i == n % 3 for i in range(3)]
        bad = record[n % 3]
        assert (bad.invalid_field, bad.reason) == (bad.field_name, f"Invalid {bad.field_name}")
        good_age = record[1].value if n % 3 != 1 else None
        assert good_age is None or 21 <= int(good_age) <= 60
    boundary = {(r.field_name, r.case_label): (r.value, r.is_invalid) for r in rows if r.kind == "boundary" and r.case_id == 1}
    assert boundary == {
        ("age", "minimum_age"): ("21", False), ("age", "maximum_age"): ("60", False), ("age", "below_minimum"): ("20", True),
        ("age", "above_maximum"): ("61", True), ("note", "minimum_length"): ("a", False), ("note", "maximum_length"): ("aaaaa", False),
        ("note", "empty_string"): ("", True), ("note", "exceeds_maximum"): ("aaaaaa", True),
    }
    assert {r.data_type for r in rows if r.case_id == 3} == {"price"}


def test_records_do_not_depend_on_partitions(spark):
    one = ds.records(cases(spark).coalesce(1), seed=3, as_of=F.lit("2024-01-01").cast("date"))
    many = ds.records(cases(spark).repartition(16), seed=3, as_of=F.lit("2024-01-01").cast("date"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    other = ds.records(cases(spark), seed=4, as_of=F.lit("2024-01-01").cast("date"))
    assert sorted(map(str, one.collect())) != sorted(map(str, other.collect()))


def test_counts_without_records(spark):
    assert ds.records(cases(spark), 0, 0, kinds=("valid", "invalid")).count() == 0
    summary = {r.case_id: tuple(r)[1:] for r in ds.dataset_summary(cases(spark), 4, 5).collect()}
    assert summary == {1: (4, 5, 8, 3), 2: (0, 0, 0, 0), 3: (4, 5, 4, 1), 4: (4, 5, 0, 1)}
    total = ds.combined_summary(cases(spark), 3, 2).first()
    assert (total.total_valid, total.total_invalid, total.total_boundary, total.total_fields, total.test_cases_processed) == (9, 6, 12, 5, 4)


def test_fields_from_responses(spark):
    rows = [
        (1, "email please", '```json\n[{"field_name": "Age", "data_type": "age", "required": true, "constraints": {"min": 3}}, '
                            '{"field_name": "Steps", "data_type": "text"}]\n```'),
        (2, "email please", "sorry"), (3, "email please", "[]"), (4, "email please", '[] and more'), (5, "email", None),
    ]
    got = ds.case_fields(spark.createDataFrame(rows, "case_id bigint, test_case string, response string"), response="response")
    names = {r.case_id: [f.field_name for f in r.fields] for r in got.collect()}
    assert names == {1: ["Age"], 2: ["email"], 3: [], 4: ["email"], 5: ["email"]}
    fields = ds.field_table(got)
    assert {r.field_name for r in ds.merge_fields(fields).collect()} == {"Age", "email"}
    assert ds.unknown_types(ds.field_table(cases(spark))).select("field_name").distinct().collect()[0][0] in ("odd", "cost")


def test_wide_records(spark):
    fields = [("mail", "email"), ("years", "age")]
    rows = ds.wide_records(spark.range(6), "id", fields, valid=False).orderBy("id").collect()
    assert [r._invalid_field for r in rows] == ["mail", "years"] * 3
    assert all(r.mail in gen.INVALID_TEXTS["email"] for r in rows[::2])
    good = ds.wide_records(spark.range(6), "id", fields)
    assert dict(good.dtypes) == {"id": "bigint", "mail": "string", "years": "bigint"}
