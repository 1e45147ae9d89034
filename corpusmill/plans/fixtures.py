"""Tables derived from the given ones, each with the same table in plain SQL.

The given tables hold no forms, no test-case texts and no model responses; these derivations build
such rows for every row of a table, so that they grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.encoders import HashingEncoder, encoded_sql
from corpusmill.session import read_table, scratch_dir, spread
from corpusmill.sources.files import open_path

PHRASES = [
    "Enter a valid email and submit", "Call the mobile number on file", "Type the username of the buyer",
    "Fill in the full name", "Reset the password twice", "Check the age limit", "Apply the coupon at checkout",
    "Compare the price with the invoice", "Pick a birth date", "Read the test_steps and the scenario",
    "Follow the feature list", "Open the page and wait",
]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---- test-case texts from orders --------------------------------------------------------------

CASES_SQL = f"""
    SELECT o_orderkey AS case_id,
           {_sql_list(PHRASES)}[1 + o_orderkey % 12] || ', then ' ||
           lower({_sql_list(PHRASES)}[1 + (o_orderkey // 12) % 12]) || ' (' || o_orderpriority || ')' AS test_case
    FROM orders"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    key = F.col("o_orderkey")
    second = F.get(phrases, F.pmod(F.floor(key / 12), F.lit(12)).cast("int"))
    return spread(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select(
        key.alias("case_id"),
        F.concat(
            F.get(phrases, F.pmod(key, F.lit(12)).cast("int")), F.lit(", then "), F.lower(second),
            F.lit(" ("), F.col("o_orderpriority"), F.lit(")"),
        ).alias("test_case"),
    )


# ---- form pages from customers ----------------------------------------------------------------


def form_pages(spark: SparkSession, d: str) -> DataFrame:
    c = spread(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    even, third = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    html = F.concat(
        F.lit("<html><head><title>"), F.col("c_name"), F.lit('</title></head><body><form id="f'), key,
        F.lit('" class="wide card" action="/c/'), key, F.lit('"'),
        F.when(even, ' method="post"').otherwise(""), F.lit('><p><input type="text" id="i'), key,
        F.lit('" name="'), F.lower("c_mktsegment"), F.lit('" placeholder="n '), nation, F.lit('"'),
        F.when(even, " required").otherwise(""), F.lit("></p>"),
        F.when(third, F.concat(F.lit('<input type="submit" value="Go '), key, F.lit('">'))).otherwise(""),
        F.lit('<button class="b x'), nation, F.lit('" onclick="go('), key, F.lit(')"> Save <b>'), key,
        F.lit('</b></button></form><img src="a.png"><a href="/n/'), nation, F.lit('" class="nav">See '),
        F.col("c_mktsegment"), F.lit('</a><script>var x="<p>";</script></body></html>'),
    )
    return c.select(F.col("c_custkey").alias("page_id"), html.alias("html"))


# ---- model responses from orders --------------------------------------------------------------

_CASE_JSON_SQL = """'[{"test_id": "TC-' || o_orderkey || '", "feature": "' || o_orderpriority ||
    '", "test_type": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END ||
    '", "test_steps": ["open", "pay ' || o_totalprice::BIGINT || '"]}]'"""

RESPONSES_SQL = f"""
    SELECT o_orderkey AS id,
           CASE o_orderkey % 5 WHEN 0 THEN {_CASE_JSON_SQL} WHEN 1 THEN '[]'
                WHEN 2 THEN '```json' || chr(10) || {_CASE_JSON_SQL} || chr(10) || '```'
                WHEN 3 THEN '```' || chr(10) || {_CASE_JSON_SQL} || chr(10) || '```'
                ELSE {_CASE_JSON_SQL} || ' trailing words' END AS response
    FROM orders"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit('[{"test_id": "TC-'), key.cast("string"), F.lit('", "feature": "'), F.col("o_orderpriority"),
        F.lit('", "test_type": "'), F.when(key % 2 == 0, "positive").otherwise("negative"),
        F.lit('", "test_steps": ["open", "pay '), F.bround("o_totalprice").cast("bigint").cast("string"), F.lit('"]}]'),
    )
    turn = key % 5
    fenced = lambda mark: F.concat(F.lit(mark + "\n"), text, F.lit("\n```"))
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return spread(orders, "o_orderkey").select(
        key.alias("id"),
        F.when(turn == 0, text).when(turn == 1, "[]").when(turn == 2, fenced("```json")).when(turn == 3, fenced("```"))
        .otherwise(F.concat(text, F.lit(" trailing words"))).alias("response"),
    )


FIELD_RESPONSES_SQL = f"""
    SELECT case_id, test_case,
           CASE case_id % 3
             WHEN 0 THEN '```json' || chr(10) || '[{{"field_name": "Buyer_' || case_id % 7 ||
                  '", "data_type": "text", "required": false, "constraints": {{"max_length": ' || 20 + case_id % 9 || '}}}}]' ||
                  chr(10) || '```'
             WHEN 1 THEN 'no fields here'
             ELSE '[{{"field_name": "feature", "data_type": "text", "required": true, "constraints": {{}}}}, ' ||
                  '{{"field_name": "Age", "data_type": "age", "required": true, "constraints": {{"min": 21}}}}]' END AS response
    FROM ({CASES_SQL})"""


def field_responses(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("case_id")
    named = F.concat(
        F.lit('```json\n[{"field_name": "Buyer_'), (key % 7).cast("string"),
        F.lit('", "data_type": "text", "required": false, "constraints": {"max_length": '), (20 + key % 9).cast("string"),
        F.lit("}}]\n```"),
    )
    fixed = (
        '[{"field_name": "feature", "data_type": "text", "required": true, "constraints": {}}, '
        '{"field_name": "Age", "data_type": "age", "required": true, "constraints": {"min": 21}}]'
    )
    return cases(spark, d).withColumn(
        "response", F.when(key % 3 == 0, named).when(key % 3 == 1, "no fields here").otherwise(fixed)
    )


# ---- a folder of files from pages --------------------------------------------------------------

PAGE_FILES_SQL = """
    SELECT page_id, CASE page_id % 5 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END || 'p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.txt' ELSE '.MD' END AS filename,
           CASE WHEN page_id % 5 = 3 THEN '' ELSE html END AS body FROM pages"""


def page_folder(spark: SparkSession, d: str) -> str:
    """A file per page in a new shared folder: ordinary, hidden and empty ones, in folders of their own kind."""
    key, folder = F.col("page_id"), scratch_dir(spark, "page-files")
    name = F.concat(F.when(key % 5 == 1, "_").when(key % 5 == 2, ".").otherwise(""), F.lit("p"), key.cast("string"), F.when(key % 2 == 0, ".txt").otherwise(".MD"))
    rows = spread(read_table(spark, d, "pages").select("page_id", "html"), "page_id")
    rows = rows.select(F.concat(F.lit(f"{folder}/k"), (key % 3).cast("string"), F.lit("/"), name).alias("path"), F.when(key % 5 == 3, "").otherwise(F.col("html")).alias("body"))

    def write(batches):
        for batch in batches:
            for path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = open_path(path)
                system.create_dir(inner.rsplit("/", 1)[0])
                with system.open_output_stream(inner) as out:
                    out.write((body or "").encode())
            yield batch.slice(0, 0)

    rows.mapInArrow(write, rows.schema).count()  # a file written twice is the same file
    return folder


# ---- mixed files from documents, pages and events ----------------------------------------------

MIXED_SQL = """
    SELECT 'd/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.MD' END AS path, text AS body FROM documents
    UNION ALL SELECT 'p/' || page_id || '.html', html FROM pages
    UNION ALL SELECT 'e/' || event_id || '.json', CASE WHEN event_id % 10 = 9 THEN '{' || props ELSE props END FROM events
    UNION ALL SELECT 'c/' || conv_id || '-' || turn || CASE WHEN turn % 2 = 0 THEN '.pdf' ELSE '.xlsx' END, text
    FROM conversations"""


def mixed_files(spark: SparkSession, d: str) -> DataFrame:
    def part(table: str, prefix: str, key: Column, ending: Column, body: Column) -> DataFrame:
        path = F.concat(F.lit(prefix), key, ending)
        return spread(read_table(spark, d, table).select(path.alias("path"), body.cast("binary").alias("content")), "path")

    number = lambda c: F.col(c).cast("string")
    broken = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return (
        part("documents", "d/", number("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".MD"), F.col("text"))
        .unionByName(part("pages", "p/", number("page_id"), F.lit(".html"), F.col("html")))
        .unionByName(part("events", "e/", number("event_id"), F.lit(".json"), broken))
        .unionByName(part(
            "conversations", "c/", F.concat(number("conv_id"), F.lit("-"), number("turn")),
            F.when(F.col("turn") % 2 == 0, ".pdf").otherwise(".xlsx"), F.col("text"),
        ))
    )


# ---- vectors with text: embeddings and the document of the same number, and all other documents --

_BARE_SQL = "(SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))"
CHUNKS_SQL = f"""
    SELECT e.vec_id AS doc_key, 0 AS chunk_id, e.embedding, e.label, d.text,
           CASE WHEN e.label % 3 = 0 THEN NULL WHEN e.label % 3 = 1 THEN '' ELSE 'doc-' || e.vec_id || '.txt' END AS filename,
           CASE WHEN e.label % 2 = 0 THEN d.source END AS source
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
    UNION ALL
    SELECT doc_id, 0, x.embedding, NULL, d.text, 'doc-' || doc_id || '.txt', d.source
    FROM documents d JOIN ({encoded_sql(_BARE_SQL, "doc_id", "text", "documents", 64)}) x USING (doc_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every given vector with the document of its number, if there is one, and every other document with an encoded vector."""
    e = read_table(spark, d, "embeddings")
    docs = spread(read_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source"), "vec_id")
    kind = F.col("label") % 3
    name = F.concat(F.lit("doc-"), F.col("vec_id").cast("string"), F.lit(".txt"))
    given = e.join(docs, "vec_id", "left").select(
        F.col("vec_id").alias("doc_key"), F.lit(0).alias("chunk_id"), "embedding", "label", "text",
        F.when(kind == 0, None).when(kind == 1, "").otherwise(name).alias("filename"),
        F.when(F.col("label") % 2 == 0, F.col("source")).alias("source"),
    )
    bare = docs.join(e.select("vec_id"), "vec_id", "left_anti")
    encoded = HashingEncoder.fit(docs, dimension=64).encode(bare)
    return given.unionByName(encoded.select(
        F.col("vec_id").alias("doc_key"), F.lit(0).alias("chunk_id"), "embedding", F.lit(None).cast(e.schema["label"].dataType).alias("label"),
        "text", name.alias("filename"), "source"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a query."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


HITS_SQL = """
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
        FROM embeddings q CROSS JOIN embeddings c),
    hits AS (
        SELECT query_id, vec_id, distance, 1 / (1 + distance) AS similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
        FROM pairs QUALIFY rank <= {k})"""
