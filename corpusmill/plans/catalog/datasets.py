"""Generated values and record sets.

The twins compute the same draws with another engine's MD5 and string functions; the record keys
come from given tables, so every query grows with its table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import fieldtypes as ft
from corpusmill.functions import generators as gen
from corpusmill.functions.draws import Draws
from corpusmill.operators import datasets as ds
from corpusmill.operators.rows import unnest
from corpusmill.plans import fixtures
from corpusmill.plans.catalog.fields import CASE_FIELDS_SQL, RESPONSE_FIELDS_SQL, detect_sql
from corpusmill.plans.catalog.registry import query
from corpusmill.session import finely, read_table, scratch_dir, spread
from corpusmill.sources.exports import export_json

SEED = 7
AS_OF = "2024-06-30"


def as_of():
    return F.lit(AS_OF).cast("date")


class DrawsSql:
    """The draws of one record and field as SQL text."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def bits(self, slot: int | str) -> str:
        block = f"'{slot // 4}'" if isinstance(slot, int) else f"({slot} // 4)::VARCHAR"
        start = str(slot % 4 * 8 + 1) if isinstance(slot, int) else f"({slot} % 4 * 8 + 1)::BIGINT"
        return f"('0x' || substr(md5({self.prefix} || ':' || {block}), {start}, 8))::BIGINT"

    def between(self, slot: int | str, low: str | int, high: str | int) -> str:
        return f"({low} + {self.bits(slot)} % ({high} - {low} + 1))"

    def pick(self, slot: int | str, pool: list[str]) -> str:
        return f"{fixtures._sql_list(pool)}[1 + {self.bits(slot)} % {len(pool)}]"


def valid_sql(kind: str, prefix: str, low: str = "", high: str = "") -> str:
    d = DrawsSql(prefix)
    if kind == "email":
        return f"lower({d.pick(0, gen.FIRST_NAMES)}) || '.' || lower({d.pick(1, gen.LAST_NAMES)}) || {d.between(2, 1, 999)} || '@' || {d.pick(3, gen.MAIL_DOMAINS)}"
    if kind == "phone":
        a, p, n = d.between(0, 200, 999), d.between(1, 200, 999), d.between(2, 1000, 9999)
        return f"CASE {d.bits(3)} % 3 WHEN 0 THEN '(' || {a} || ') ' || {p} || '-' || {n} WHEN 1 THEN {a} || '-' || {p} || '-' || {n} ELSE '+1' || {a} || {p} || {n} END"
    if kind == "name":
        return f"{d.pick(0, gen.FIRST_NAMES)} || ' ' || {d.pick(1, gen.LAST_NAMES)}"
    if kind == "username":
        return f"lower({d.pick(0, gen.FIRST_NAMES)}) || {d.pick(2, ['', '_', '.'])} || {d.between(1, 100, 9999)}"
    if kind == "password":
        def char(slot, chars):
            return f"substr('{chars}', 1 + {d.bits(slot)} % {len(chars)}, 1)"
        rest = f"array_to_string(list_transform(range(5, {d.between(0, 8, 16)} + 1), lambda i: {char('i', gen.PASSWORD_CHARS)}), '')"
        return " || ".join([char(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), char(2, "abcdefghijklmnopqrstuvwxyz"), char(3, "0123456789"), char(4, gen.SYMBOLS), rest])
    if kind in ("age", "number"):
        return d.between(0, low, high)
    if kind == "price":
        return f"{d.between(0, f'round({low} * 100)::BIGINT', f'round({high} * 100)::BIGINT')} / 100.0::DOUBLE"
    if kind == "date":
        return f"strftime(DATE '{AS_OF}' - {d.between(0, 0, 365)}::INTEGER, '%Y-%m-%d')"
    if kind == "discount_code":
        return f"{d.pick(0, gen.CODE_PREFIXES)} || {d.pick(1, gen.CODE_NUMBERS)}"
    if kind == "url":
        return f"{d.pick(0, gen.PROTOCOLS)} || {d.pick(1, gen.SITES)} || {d.pick(2, gen.PATHS)}"
    if kind == "address":
        return f"{d.between(0, 100, 9999)} || ' ' || {d.pick(1, gen.STREETS)} || ', ' || {d.pick(2, gen.CITIES)} || ', ' || {d.pick(3, gen.STATES)} || ' ' || {d.between(4, 10000, 99999)}"
    if kind == "zipcode":
        return f"({d.between(0, 10000, 99999)})::VARCHAR"
    if kind == "credit_card":
        return " || ' ' || ".join([d.between(0, 4000, 4999), *[d.between(i, 1000, 9999) for i in (1, 2, 3)]])
    length = d.between(0, low, high)
    words = f"list_transform(range(1, {length} // 5 + 1), lambda i: {d.pick('i', gen.WORDS)})"
    return f"substr(array_to_string({words}, ' '), 1, {length})"


def invalid_sql(kind: str, prefix: str, low: str = "", high: str = "") -> str:
    d = DrawsSql(prefix)
    if kind in gen.INVALID_TEXTS:
        pool = "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in gen.INVALID_TEXTS[kind]) + "]"
        return f"{pool}[1 + {d.bits(0)} % {len(gen.INVALID_TEXTS[kind])}]"
    if kind == "price":
        pool = f"list_filter({gen.INVALID_PRICES}::DOUBLE[], lambda v: v < {low} OR v > {high})"
    else:
        values = gen.INVALID_AGES if kind == "age" else gen.INVALID_NUMBERS
        pool = f"list_concat([({low} - 1)::BIGINT, ({high} + 1)::BIGINT], list_filter({values}::BIGINT[], lambda v: v < {low} OR v > {high}))"
    return f"({pool})[1 + {d.bits(0)} % len({pool})]"


DEFAULTS = {"age": ("18", "100"), "number": ("1", "100"), "price": ("1.0::DOUBLE", "1000.0::DOUBLE"), "text": ("10", "100")}


def _register_generator(kind: str) -> None:
    prefix = f"'{SEED}:' || c_custkey || ':{kind}'"
    low, high = DEFAULTS.get(kind, ("", ""))

    def values(spark, d, valid):
        draws = Draws(SEED, F.col("c_custkey"), F.lit(kind))
        return read_table(spark, d, "customer").select("c_custkey", gen.typed_value(kind, draws, valid, None, as_of()).alias("value"))

    query(f"gen_{kind}_valid", f"SELECT c_custkey, {valid_sql(kind, prefix, low, high)} AS value FROM customer")(
        lambda spark, d: values(spark, d, True))
    query(f"gen_{kind}_invalid", f"SELECT c_custkey, {invalid_sql(kind, prefix, low, high)} AS value FROM customer")(
        lambda spark, d: values(spark, d, False))


for _kind in ft.DATA_TYPES:
    _register_generator(_kind)


def by_type_sql(kind: str, prefix: str, good: str, bounds: dict[str, tuple[str, str]]) -> str:
    """Value of the type in column ``kind`` as text; unknown types as ``text``."""
    cases = []
    for known in ft.DATA_TYPES:
        low, high = bounds.get(known, ("", ""))
        cases.append(
            f"WHEN '{known}' THEN CASE WHEN {good} THEN ({valid_sql(known, prefix, low, high)})::VARCHAR "
            f"ELSE ({invalid_sql(known, prefix, low, high)})::VARCHAR END"
        )
    return f"CASE {kind} {' '.join(cases)} END"


@query("gen_dispatch", f"""
    SELECT p_partkey, name, {by_type_sql("data_type", f"'{SEED}:' || p_partkey || ':' || name", "true", DEFAULTS)} AS value
    FROM (SELECT p_partkey, name, {detect_sql('name')} AS data_type FROM (
        SELECT p_partkey, unnest(['mail of ' || p_brand, 'tel', 'user', 'p_name', 'pwd', 'age', 'dob', 'cost', 'promo',
            'website', 'address', 'zip', 'card', 'count', p_type]) AS name FROM part))""")
def gen_dispatch(spark, d):
    """Values by field name alone; the type comes from the name."""
    fixed = ["tel", "user", "p_name", "pwd", "age", "dob", "cost", "promo", "website", "address", "zip", "card", "count"]
    names = F.array(F.concat(F.lit("mail of "), "p_brand"), *[F.lit(n) for n in fixed], F.col("p_type"))
    rows = read_table(spark, d, "part").select("p_partkey", F.explode(names).alias("name"))
    draws = Draws(SEED, F.col("p_partkey"), F.col("name"))
    kind = ft.detect_field_type(F.col("name"))
    return rows.withColumn("kind", kind).select(
        "p_partkey", "name", gen.field_value(F.col("kind"), F.lit(True), draws, None, as_of()).alias("value")
    )


# ---- record sets -----------------------------------------------------------------------------


def _cases(spark, d):
    return ds.case_fields(fixtures.cases(spark, d))


def _constrained(spark, d):
    return ds.case_fields(fixtures.field_responses(spark, d), response="response")


def _records(cases, kinds, n_valid=3, n_invalid=2):
    return ds.records(cases, n_valid, n_invalid, seed=SEED, as_of=as_of(), kinds=kinds)


def records_sql(n_valid: int, n_invalid: int, fields: str = CASE_FIELDS_SQL) -> str:
    """Valid and invalid rows of every case; the type of a mentioned field is its name."""
    value = by_type_sql("data_type", f"'{SEED}:' || case_id || '/' || kind || '/' || record_id || ':' || field_name", "NOT bad", BOUNDS)
    return f"""
        SELECT case_id, kind, record_id, pos, field_name, {value} AS value, CASE WHEN bad THEN field_name END AS invalid_field,
               CASE WHEN bad THEN 'Invalid ' || field_name END AS reason, NULL::VARCHAR AS case_label, bad AS is_invalid
        FROM (
            SELECT f.*, r.kind, r.record_id, r.kind = 'invalid' AND r.record_id % n_fields = f.pos AS bad,
                   CASE WHEN field_name LIKE 'Buyer%' THEN 'text' ELSE lower(field_name) END AS data_type
            FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n_fields FROM ({fields})) f,
                 (SELECT 'valid' AS kind, unnest(range({n_valid})) AS record_id
                  UNION ALL SELECT 'invalid', unnest(range({n_invalid}))) r)"""


# 'Age' with a minimum and 'Buyer' with a maximum length stem from responses; mentions have no bounds.
BOUNDS = {
    **DEFAULTS,
    "age": ("(CASE WHEN field_name = 'Age' THEN 21 ELSE 18 END)", "100"),
    "text": ("10", "(20 + case_id % 9)"),
}
COLUMNS = ["case_id", "kind", "record_id", "pos", "field_name", "value", "invalid_field", "reason", "case_label", "is_invalid"]


def _shown(rows):
    return rows.withColumn("pos", F.col("pos").cast("bigint")).select(*COLUMNS)


@query("ds_valid", f"SELECT * FROM ({records_sql(3, 0)})")
def ds_valid(spark, d):
    return _shown(_records(_cases(spark, d), ("valid",)))


@query("ds_invalid", f"SELECT * FROM ({records_sql(0, 2)})")
def ds_invalid(spark, d):
    return _shown(_records(_cases(spark, d), ("invalid",)))


@query("ds_constrained", f"SELECT * FROM ({records_sql(2, 2, RESPONSE_FIELDS_SQL)})")
def ds_constrained(spark, d):
    """Fields with bounds from a response."""
    return _shown(_records(_constrained(spark, d), ("valid", "invalid"), 2, 2))


def boundary_sql(fields: str) -> str:
    return f"""
        SELECT case_id, 'boundary' AS kind, b.n AS record_id, pos, field_name, b.value, NULL::VARCHAR AS invalid_field,
               NULL::VARCHAR AS reason, b.case_label, b.bad AS is_invalid
        FROM (SELECT *, CASE WHEN field_name = 'Age' THEN 21 ELSE 18 END AS low,
                     CASE WHEN field_name LIKE 'Buyer%' THEN 'text' ELSE lower(field_name) END AS data_type,
                     20 + case_id % 9 AS longest FROM ({fields})) f,
        LATERAL (
            SELECT 0 AS n, low::VARCHAR AS value, 'minimum_age' AS case_label, false AS bad WHERE data_type = 'age'
            UNION ALL SELECT 1, '100', 'maximum_age', false WHERE data_type = 'age'
            UNION ALL SELECT 2, (low - 1)::VARCHAR, 'below_minimum', true WHERE data_type = 'age'
            UNION ALL SELECT 3, '101', 'above_maximum', true WHERE data_type = 'age'
            UNION ALL SELECT 0, '1.0', 'minimum_price', false WHERE data_type = 'price'
            UNION ALL SELECT 1, '1000.0', 'maximum_price', false WHERE data_type = 'price'
            UNION ALL SELECT 2, '0.01', 'very_small_price', false WHERE data_type = 'price'
            UNION ALL SELECT 3, '-1.0', 'negative_price', true WHERE data_type = 'price'
            UNION ALL SELECT 0, 'a', 'minimum_length', false WHERE data_type = 'text'
            UNION ALL SELECT 1, repeat('a', longest), 'maximum_length', false WHERE data_type = 'text'
            UNION ALL SELECT 2, '', 'empty_string', true WHERE data_type = 'text'
            UNION ALL SELECT 3, repeat('a', longest + 1), 'exceeds_maximum', true WHERE data_type = 'text') b"""


@query("ds_boundary", boundary_sql(CASE_FIELDS_SQL))
def ds_boundary(spark, d):
    return _shown(_records(_cases(spark, d), ("boundary",)))


@query("ds_full", f"SELECT * FROM ({records_sql(3, 2, RESPONSE_FIELDS_SQL)}) UNION ALL {boundary_sql(RESPONSE_FIELDS_SQL)}")
def ds_full(spark, d):
    """Valid, invalid and boundary rows of every case in one pass."""
    return _shown(_records(_constrained(spark, d), ("valid", "invalid", "boundary")))


@query("ds_part_boundary", """
    SELECT p_partkey, unnest(['minimum_price', 'maximum_price', 'very_small_price', 'negative_price',
                              'minimum_length', 'maximum_length', 'empty_string', 'exceeds_maximum']) AS case_label,
           unnest([p_retailprice::VARCHAR, '1000.0', '0.01', '-1.0', 'a', repeat('a', p_size), '', repeat('a', p_size + 1)]) AS value
    FROM part""")
def ds_part_boundary(spark, d):
    """Boundary values of a price and a text whose bounds come from the part."""
    bounds = [
        ("price", F.create_map(F.lit("min"), F.col("p_retailprice"))),
        ("text", F.create_map(F.lit("max_length"), F.col("p_size").cast("double"))),
    ]
    found = F.concat(*[gen.boundary_cases(F.lit(kind), limits) for kind, limits in bounds])
    return read_table(spark, d, "part").select("p_partkey", F.explode(found).alias("b")).select(
        "p_partkey", "b.case_label", "b.value"
    )


N_BOUNDARY_SQL = "4 * count(*) FILTER (WHERE lower(field_name) IN ('age', 'price', 'text') OR field_name LIKE 'Buyer%')"


@query("ds_summary", f"""
    SELECT o_orderkey AS case_id, CASE WHEN count(field_name) > 0 THEN 5 ELSE 0 END::BIGINT AS total_valid,
           CASE WHEN count(field_name) > 0 THEN 3 ELSE 0 END::BIGINT AS total_invalid,
           ({N_BOUNDARY_SQL})::BIGINT AS total_boundary, count(field_name) AS total_fields
    FROM orders LEFT JOIN ({CASE_FIELDS_SQL}) ON case_id = o_orderkey GROUP BY o_orderkey""")
def ds_summary(spark, d):
    return ds.dataset_summary(_cases(spark, d))


@query("ds_multi_case", f"""
    SELECT (3 * count(DISTINCT case_id))::BIGINT AS total_valid, (2 * count(DISTINCT case_id))::BIGINT AS total_invalid,
           ({N_BOUNDARY_SQL})::BIGINT AS total_boundary, (SELECT count(*) FROM orders) AS test_cases_processed,
           count(DISTINCT field_name) AS total_fields
    FROM ({RESPONSE_FIELDS_SQL})""")
def ds_multi_case(spark, d):
    return ds.combined_summary(_constrained(spark, d))


WIDE = [("email", "email"), ("full_name", "name"), ("age", "age"), ("price", "price"), ("city_address", "address")]


def _wide_prefix(name: str) -> str:
    return f"'{SEED}:' || c_custkey || ':{name}'"


def _wide_sql(name: str, kind: str) -> str:
    return valid_sql(kind, _wide_prefix(name), *DEFAULTS.get(kind, ("", "")))


@query("ds_wide_valid", "SELECT c_custkey, " + ", ".join(f"{_wide_sql(n, k)} AS {n}" for n, k in WIDE) + " FROM customer")
def ds_wide_valid(spark, d):
    """One typed record per customer."""
    return ds.wide_records(read_table(spark, d, "customer"), "c_custkey", WIDE, SEED, True, None, as_of())


@query("ds_wide_invalid", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_custkey % {len(WIDE)} = {i} THEN ({invalid_sql(k, _wide_prefix(n), *DEFAULTS.get(k, ('', '')))})::VARCHAR "
    f"ELSE ({_wide_sql(n, k)})::VARCHAR END AS {n}" for i, (n, k) in enumerate(WIDE)
) + f", {fixtures._sql_list([n for n, _ in WIDE])}[1 + c_custkey % {len(WIDE)}] AS _invalid_field, "
    f"'Invalid ' || {fixtures._sql_list([n for n, _ in WIDE])}[1 + c_custkey % {len(WIDE)}] AS _reason FROM customer")
def ds_wide_invalid(spark, d):
    return ds.wide_records(read_table(spark, d, "customer"), "c_custkey", WIDE, SEED, False, None, as_of())


@query("export_records", f"""
    SELECT kind, count(*) AS n, count(value) AS n_values FROM (
        SELECT kind, value FROM ({records_sql(3, 2)}) UNION ALL SELECT kind, value FROM ({boundary_sql(CASE_FIELDS_SQL)}))
    GROUP BY kind""")
def export_records(spark, d):
    """Records written as JSON with a folder per kind, and read back."""
    path = scratch_dir(spark, "export")
    # a folder per kind makes each task sort its records, so a task gets few cases
    rows = _records(ds.case_fields(finely(fixtures.cases(spark, d), "case_id")), ("valid", "invalid", "boundary"))
    export_json(rows, path, by="kind")
    stored = spark.read.schema(rows.schema).json(path)
    return stored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


@query("gen_bounds_one_sided", """
    SELECT p_partkey, kind, side, TRUE AS within FROM part,
           (VALUES ('age'), ('number'), ('price'), ('text')) AS k(kind), (VALUES ('low'), ('high')) AS s(side)
    UNION ALL SELECT p_partkey, kind, 'crossed', TRUE FROM part, (VALUES ('age'), ('number'), ('price')) AS k(kind)""")
def gen_bounds_one_sided(spark, d):
    """Values keep to the one bound they are given, also beyond the other's default; crossed bounds give none."""
    part = spread(read_table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    draws = Draws(7, F.col("p_partkey"), F.lit("bound"))
    part = part.select("p_partkey", F.col("p_size").cast("double").alias("size"), draws.digest(0).alias("_d0"))  # shared by all values
    draws = draws.holding(F.col("_d0"))
    makers = {"age": gen.valid_age, "number": gen.valid_number, "price": gen.valid_price, "text": gen.valid_text}
    rows = []
    for kind, make in makers.items():
        low, high = ("min_length", "max_length") if kind == "text" else ("min", "max")
        measure = F.length if kind == "text" else (lambda v: v)
        above, below = F.col("size") + (0 if kind == "text" else 1500), F.col("size") / 2 if kind != "text" else F.col("size")
        over = make(draws, F.create_map(F.lit(low), above))
        under = make(draws, F.create_map(F.lit(high), below))
        # a text promises its greatest length only
        rows.append(F.struct(F.lit(kind).alias("kind"), F.lit("low").alias("side"), (over.isNotNull() if kind == "text" else measure(over) >= above).alias("within")))
        rows.append(F.struct(F.lit(kind).alias("kind"), F.lit("high").alias("side"), (measure(under) <= below).alias("within")))
        if kind != "text":
            crossed = make(draws, F.create_map(F.lit(low), above, F.lit(high), below))
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit("crossed").alias("side"), crossed.isNull().alias("within")))
    return unnest(part, ["p_partkey"], F.array(*rows), "_n", "r").select("p_partkey", "r.*")  # a plain explode makes every value twice
