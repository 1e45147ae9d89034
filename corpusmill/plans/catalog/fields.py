"""Field typing and field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import fieldtypes as ft
from corpusmill.functions.responses import strip_fences
from corpusmill.operators import datasets as ds
from corpusmill.plans import fixtures
from corpusmill.plans.catalog.registry import query
from corpusmill.session import read_table, spread


def detect_sql(name: str) -> str:
    """Type of a name: the first rule word list that matches."""
    rules = [f"WHEN regexp_matches(lower({name}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in ft.NAME_RULES]
    return "CASE " + " ".join(rules) + " ELSE 'text' END"


WORDS_SQL = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
# The extraction patterns without look-around, for an engine that has none.
MENTIONS_SQL = [
    ("email", r"\b(email|e-mail|mail)\b"), ("phone", r"\b(phone|mobile|telephone|tel)\b"),
    ("username", r"\b(username|user[\s_]name)\b"), ("name", r"\bname([^\s_]|$)|full[\s_]name\b"),
    ("password", r"\b(password|pwd|pass)\b"), ("age", r"\bage\b"),
    ("discount_code", r"\b(discount|promo|coupon|code)\b"), ("price", r"\b(price|cost|amount|total)\b"),
    ("date", r"\b(date|dob|birth[\s_]date)\b"),
]
MENTIONED_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(test_case), '{p}') THEN '{n}' END" for n, p in MENTIONS_SQL
) + "], lambda x: x IS NOT NULL)"
CASE_FIELDS_SQL = f"""
    SELECT case_id, unnest(range(len(f))) AS pos, unnest(f) AS field_name
    FROM (SELECT case_id, {MENTIONED_SQL} AS f FROM ({fixtures.CASES_SQL}))"""
RESPONSE_FIELDS_SQL = f"""
    SELECT case_id, unnest(range(len(f))) AS pos, unnest(f) AS field_name FROM (
        SELECT case_id, CASE case_id % 3 WHEN 0 THEN ['Buyer_' || case_id % 7] WHEN 1 THEN {MENTIONED_SQL} ELSE ['Age'] END AS f
        FROM ({fixtures.CASES_SQL}))"""


@query("field_detect_words", f"""
    SELECT {detect_sql('word')} AS data_type, count(*) AS words FROM ({WORDS_SQL}) GROUP BY 1""")
def field_detect_words(spark, d):
    """Types of all words of all documents taken as field names."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(words.alias("word")).groupBy(
        ft.detect_field_type(F.col("word")).alias("data_type")
    ).agg(F.count(F.lit(1)).alias("words"))


_NAMES_SQL = """SELECT p_partkey, unnest(['p_name', 'buyer_' || p_name, p_type || '_count', p_brand || ' zipcode',
    'country of ' || p_brand, 'credit card ' || p_size, 'website_' || p_partkey]) AS name FROM part"""


@query("field_detect_names", f"SELECT p_partkey, name, {detect_sql('name')} AS data_type FROM ({_NAMES_SQL})")
def field_detect_names(spark, d):
    """Names built from part columns, among them those the rules place oddly."""
    names = F.array(
        F.lit("p_name"), F.concat(F.lit("buyer_"), "p_name"), F.concat("p_type", F.lit("_count")),
        F.concat("p_brand", F.lit(" zipcode")), F.concat(F.lit("country of "), "p_brand"),
        F.concat(F.lit("credit card "), F.col("p_size").cast("string")),
        F.concat(F.lit("website_"), F.col("p_partkey").cast("string")),
    )
    return read_table(spark, d, "part").select("p_partkey", F.explode(names).alias("name")).withColumn(
        "data_type", ft.detect_field_type(F.col("name"))
    )


@query("field_extract", f"""
    SELECT case_id, pos, field_name, field_name AS data_type, true AS required FROM ({CASE_FIELDS_SQL})""")
def field_extract(spark, d):
    fields = ds.field_table(ds.case_fields(fixtures.cases(spark, d)))
    return fields.select("case_id", F.col("pos").cast("bigint").alias("pos"), "field_name", "data_type", "required")


@query("field_extract_response", f"""
    SELECT case_id, pos, field_name, CASE WHEN field_name LIKE 'Buyer%' THEN 'text' ELSE lower(field_name) END AS data_type,
           field_name NOT LIKE 'Buyer%' AS required,
           CASE WHEN field_name LIKE 'Buyer%' THEN 20.0 + case_id % 9 END::DOUBLE AS max_length,
           CASE WHEN field_name = 'Age' THEN 21.0 END::DOUBLE AS min_value
    FROM ({RESPONSE_FIELDS_SQL})""")
def field_extract_response(spark, d):
    """Fields of a model response, or those mentioned in the text when it does not parse."""
    fields = ds.field_table(ds.case_fields(fixtures.field_responses(spark, d), response="response"))
    return fields.select(
        "case_id", F.col("pos").cast("bigint").alias("pos"), "field_name", "data_type", "required",
        F.try_element_at("constraints", F.lit("max_length")).alias("max_length"),
        F.try_element_at("constraints", F.lit("min")).alias("min_value"),
    )


@query("field_types", f"""
    SELECT t.data_type, t.pos, count(w.word) AS words
    FROM (SELECT unnest({fixtures._sql_list(ft.DATA_TYPES)}) AS data_type, unnest(range({len(ft.DATA_TYPES)})) AS pos) t
    LEFT JOIN (SELECT word, {detect_sql('word')} AS data_type FROM ({WORDS_SQL})) w USING (data_type) GROUP BY 1, 2""")
def field_types(spark, d):
    """The type registry with the number of document words of each type, unused types included."""
    registry = spark.createDataFrame(list(enumerate(ft.DATA_TYPES)), "pos bigint, data_type string")
    used = field_detect_words(spark, d)
    return F.broadcast(registry).join(used, "data_type", "left").select(
        "data_type", "pos", F.coalesce("words", F.lit(0).cast("bigint")).alias("words")
    )


_ROLE_NAMES_SQL = "SELECT conv_id, turn, unnest([role, 'Test_Steps', 'feature', 'scenario ' || turn, 'RESULT']) AS field_name FROM conversations"


@query("field_structure_names", f"""
    SELECT conv_id, turn, field_name FROM ({_ROLE_NAMES_SQL})
    WHERE lower(field_name) NOT IN ('test_id', 'feature', 'test_scenario', 'test_type', 'preconditions', 'test_steps',
        'expected_result', 'source_document', 'test_case', 'scenario', 'steps', 'result')""")
def field_structure_names(spark, d):
    names = F.array(
        F.col("role"), F.lit("Test_Steps"), F.lit("feature"), F.concat(F.lit("scenario "), F.col("turn").cast("string")),
        F.lit("RESULT"),
    )
    exploded = read_table(spark, d, "conversations").select("conv_id", "turn", F.explode(names).alias("field_name"))
    return exploded.filter(~ft.is_structure_name(F.col("field_name")))


@query("field_unknown_types", f"""
    SELECT event_type AS data_type, count(*) AS fields FROM events
    WHERE event_type NOT IN ({', '.join(f"'{t}'" for t in ft.DATA_TYPES)}) GROUP BY 1""")
def field_unknown_types(spark, d):
    typed = read_table(spark, d, "events").select("event_id", F.col("event_type").alias("data_type"))
    return ds.unknown_types(typed).groupBy("data_type").agg(F.count(F.lit(1)).alias("fields"))


@query("field_merge", f"""
    SELECT field_name, max_length FROM (
        SELECT case_id, pos, field_name, CASE WHEN field_name LIKE 'Buyer%' THEN 20.0 + case_id % 9 END::DOUBLE AS max_length
        FROM ({RESPONSE_FIELDS_SQL}))
    QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY case_id, pos) = 1""")
def field_merge(spark, d):
    """One definition per field name: that of the first case."""
    fields = ds.field_table(ds.case_fields(fixtures.field_responses(spark, d), response="response"))
    return ds.merge_fields(fields).select(
        "field_name", F.try_element_at("constraints", F.lit("max_length")).alias("max_length")
    )


@query("response_fences", """
    SELECT id, regexp_replace(regexp_replace(trim(response), '```json\\n?', '', 'g'), '```\\n?', '', 'g') AS clean
    FROM (""" + fixtures.RESPONSES_SQL + ")")
def response_fences(spark, d):
    return fixtures.responses(spark, d).select("id", strip_fences(F.col("response")).alias("clean"))
