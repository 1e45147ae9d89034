"""Prompts, responses, requests and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import prompts as pr
from corpusmill.functions import responses as rs
from corpusmill.functions.encoders import HashingEncoder
from corpusmill.operators import generation, requests
from corpusmill.operators.elements import parse_pages, structure_context
from corpusmill.plans import answers, fixtures
from corpusmill.plans.catalog.pages import STRUCTURE_SQL
from corpusmill.plans.catalog.registry import query
from corpusmill.plans.catalog.vectors import CHUNK_HITS, K, LISTED, _document_chunks, text_hits_sql
from corpusmill.session import materialize, read_table, scratch_dir

NL = "chr(10)"
CONTEXTS_SQL = f"""
    {CHUNK_HITS},
    grounded AS (
        SELECT query_id, string_agg('[Source: ' || coalesce(filename, source, 'Unknown') || ']' || chr(10) || coalesce(text, ''),
                   chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
               coalesce(string_agg(DISTINCT {LISTED}, '|' ORDER BY {LISTED}), '') AS sources
        FROM hits GROUP BY query_id)"""


def _lines(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("prompt_test_cases", f"""
    WITH {CONTEXTS_SQL}
    SELECT query_id, sources, 'Documentation:' || {NL} || context || {NL} || {NL} || 'Feature under test: vector ' || query_id ||
           {NL} || {NL} || 'Write three to five test cases for this feature as a JSON array.' AS user_prompt
    FROM grounded""")
def prompt_test_cases(spark, d):
    """Grounded test-case prompts, one retrieval for context and sources."""
    queries = fixtures.vector_queries(spark, d).withColumn("query", F.concat(F.lit("vector "), F.col("query_id").cast("string")))
    return answers.test_case_requests(queries, fixtures.chunks(spark, d), K).select(
        "query_id", F.array_join("sources", "|").alias("sources"), F.col("user").alias("user_prompt")
    )


@query("prompt_scripts", f"""
    SELECT case_id, 'Test case:' || {NL} || test_case || {NL} || {NL} || 'Page structure:' || {NL} || c_name || {NL} || {NL} ||
           'Documentation:' || {NL} || c_mktsegment || {NL} || {NL} || 'Write the complete script.' AS user_prompt
    FROM ({fixtures.CASES_SQL}) JOIN orders ON o_orderkey = case_id JOIN customer ON c_custkey = o_custkey""")
def prompt_scripts(spark, d):
    """Script prompts: a case, the page structure (here a title) and a context of its buyer."""
    owner = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("c_custkey"))
    buyer = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return fixtures.cases(spark, d).join(owner, "case_id").join(buyer, "c_custkey").select(
        "case_id", pr.script_prompt(F.col("test_case"), F.col("c_name"), F.col("c_mktsegment")).alias("user_prompt")
    )


@query("prompt_questions", f"""
    SELECT case_id, 'Say in plain words what this test case checks:' || {NL} || test_case AS explain,
           'Answer from this documentation only:' || {NL} || test_case || {NL} || {NL} || 'Question: Is it paid?' AS grounded,
           'All positive and negative test cases for ' || test_case AS rewritten,
           'Test case:' || {NL} || test_case || {NL} || {NL} || 'List its input fields.' AS fields
    FROM ({fixtures.CASES_SQL})""")
def prompt_questions(spark, d):
    text = F.col("test_case")
    return fixtures.cases(spark, d).select(
        "case_id", pr.explain_prompt(text).alias("explain"), pr.grounded_prompt(text, F.lit("Is it paid?")).alias("grounded"),
        pr.all_cases_query(text).alias("rewritten"), pr.fields_prompt(text).alias("fields"),
    )


@query("prompt_messages", """
    SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest(['system', 'user']) AS role,
           unnest(['You explain test cases in plain words.', text]) AS content FROM conversations""")
def prompt_messages(spark, d):
    chat = F.posexplode(pr.messages(pr.SYSTEM_EXPLAIN, F.col("text"))).alias("pos", "m")
    return read_table(spark, d, "conversations").select("conv_id", "turn", chat).select("conv_id", "turn", "pos", "m.*")


@query("response_cases", f"""
    SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'parsed' WHEN 1 THEN 'empty' ELSE 'raw' END AS status,
           CASE WHEN o_orderkey % 5 = 0 THEN 'TC-' || o_orderkey END AS test_id,
           CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS feature,
           CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END END AS test_type,
           CASE WHEN o_orderkey % 5 = 0 THEN 'open|pay ' || o_totalprice::BIGINT END AS steps,
           CASE WHEN o_orderkey % 5 > 1 THEN r.response END AS kept
    FROM orders JOIN ({fixtures.RESPONSES_SQL}) r ON r.id = o_orderkey""")
def response_cases(spark, d):
    """Responses as test-case rows; empty ones are flagged, others kept as they are."""
    parsed = fixtures.responses(spark, d).select(
        "id", rs.parse_status(F.col("response")).alias("status"),
        F.explode_outer(rs.parse_cases(F.col("response"))).alias("c"), "response",
    )
    return parsed.select(
        "id", "status", "c.test_id", "c.feature", "c.test_type", F.array_join("c.test_steps", "|").alias("steps"),
        F.when(F.col("status") == "raw", F.col("response")).alias("kept"),
    )


@query("response_scripts", f"""
    SELECT id, CASE WHEN response LIKE '```python%' THEN trim(string_split(string_split(response, '```python')[2], '```')[1], ' ' || {NL})
                    WHEN response LIKE '```%' THEN trim(string_split(string_split(response, '```')[2], '```')[1], ' ' || {NL})
                    ELSE response END AS script
    FROM (SELECT id, CASE WHEN id % 2 = 0 THEN replace(response, '```json', '```python') ELSE response END AS response
          FROM ({fixtures.RESPONSES_SQL}))""")
def response_scripts(spark, d):
    python = F.when(F.col("id") % 2 == 0, F.replace("response", F.lit("```json"), F.lit("```python"))).otherwise(F.col("response"))
    return fixtures.responses(spark, d).select("id", rs.clean_script(python).alias("script"))


def stub_model():
    """A stand-in for a hosted model: answers by rule, always fails on one kind of prompt."""

    def call(system: str, user: str) -> tuple[str, int]:
        if "coupon" in user:
            raise RuntimeError("no answer")
        return f"{len(user)} characters", len(system) + len(user)

    return call


def _generated(spark, d):
    prompts = fixtures.cases(spark, d).select(
        "case_id", F.lit(pr.SYSTEM_EXPLAIN).alias("system"), F.col("test_case").alias("user")
    )
    return generation.generate(prompts, stub_model, "case_id", delay=0.0)


@query("response_generate", f"""
    SELECT case_id, CASE WHEN test_case NOT LIKE '%coupon%' THEN length(test_case) || ' characters' END AS response,
           CASE WHEN test_case LIKE '%coupon%' THEN 'no answer' END AS error,
           CASE WHEN test_case LIKE '%coupon%' THEN 3 ELSE 1 END::BIGINT AS attempts,
           CASE WHEN test_case LIKE '%coupon%' THEN 0 ELSE length(test_case) + {len(pr.SYSTEM_EXPLAIN)} END::BIGINT AS tokens
    FROM ({fixtures.CASES_SQL})""")
def response_generate(spark, d):
    """Calls with retries; a request that keeps failing becomes an error row."""
    return _generated(spark, d).select("case_id", "response", "error", F.col("attempts").cast("bigint").alias("attempts"), "tokens")


@query("response_store", f"""
    WITH cases AS ({fixtures.CASES_SQL}), told AS (
        SELECT *, test_case LIKE '%coupon%' AS fails, test_case IN (SELECT test_case FROM cases WHERE case_id % 2 = 0 AND test_case NOT LIKE '%coupon%') AS from_store,
               row_number() OVER (PARTITION BY test_case ORDER BY case_id) AS nth FROM cases)
    SELECT case_id, CASE WHEN NOT fails THEN length(test_case) || ' characters' END AS response, CASE WHEN fails THEN 'no answer' END AS error, from_store,
           CASE WHEN from_store OR nth > 1 THEN 0 WHEN fails THEN 3 ELSE 1 END::BIGINT AS attempts,
           CASE WHEN from_store OR nth > 1 OR fails THEN 0 ELSE length(test_case) + {len(pr.SYSTEM_EXPLAIN)} END::BIGINT AS tokens
    FROM told""")
def response_store(spark, d):
    """All cases after those of even number: their prompts come from the store, and equal prompts are called once."""
    prompts = materialize(fixtures.cases(spark, d).select("case_id", F.lit(pr.SYSTEM_EXPLAIN).alias("system"), F.col("test_case").alias("user")), "prompts")
    store = generation.ResponseStore(spark, scratch_dir(spark, "responses"))
    store.generate(prompts.where("case_id % 2 = 0"), stub_model, "case_id", delay=0.0)
    return store.generate(prompts, stub_model, "case_id", delay=0.0).select(
        "case_id", "response", "error", "from_store", F.col("attempts").cast("bigint").alias("attempts"), "tokens")


def _grounded_sql(asked: str, k: int, more: str = "") -> str:
    """CTEs up to ``grounded(query_id, context, sources)`` over the encoded chunks of all documents."""
    return text_hits_sql(asked, k) + f""",
    grounded AS (
        SELECT query_id, string_agg('[Source: ' || coalesce(filename, source, 'Unknown') || ']' || {NL} || text,
                   {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS context,
               coalesce(string_agg(DISTINCT {LISTED}, '|' ORDER BY {LISTED}), '') AS sources
        FROM hits GROUP BY query_id){more}"""


@query("answer_cases", f"""
    WITH {_grounded_sql("SELECT item_id AS query_id, text AS query FROM benchmark", 5)},
    prompts AS (
        SELECT query_id, sources, 'Documentation:' || {NL} || context || {NL} || {NL} || 'Feature under test: ' || query || {NL} || {NL} ||
               'Write three to five test cases for this feature as a JSON array.' AS prompt
        FROM grounded JOIN asked USING (query_id))
    SELECT query_id, CASE WHEN prompt NOT LIKE '%coupon%' THEN length(prompt) || ' characters' END AS test_cases, 'raw' AS status, sources,
           CASE WHEN prompt LIKE '%coupon%' THEN 'no answer' END AS error FROM prompts""")
def answer_cases(spark, d):
    """Text features to retrieval, prompt, model answer and parsed result."""
    chunks = materialize(_document_chunks(spark, d), "chunks")
    encoder = HashingEncoder.fit(chunks)
    stored = materialize(encoder.encode(chunks), "encoded")
    features = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answers.generate_test_cases(features, stored, encoder, stub_model).select(
        "query_id", "test_cases", "status", F.array_join("sources", "|").alias("sources"), "error"
    )


@query("answer_scripts", f"""
    WITH {_grounded_sql("SELECT c_custkey AS query_id, text AS query FROM customer JOIN benchmark ON item_id = c_custkey % (SELECT count(*) FROM benchmark)", 3)},
    prompts AS (
        SELECT query_id, sources, structure_context, 'Test case:' || {NL} || query || {NL} || {NL} || 'Page structure:' || {NL} || structure_context ||
               {NL} || {NL} || 'Documentation:' || {NL} || context || {NL} || {NL} || 'Write the complete script.' AS prompt
        FROM grounded JOIN asked USING (query_id) JOIN ({STRUCTURE_SQL}) ON page_id = query_id)
    SELECT query_id, CASE WHEN prompt NOT LIKE '%coupon%' THEN length(prompt) || ' characters' END AS script, structure_context, sources,
           CASE WHEN prompt LIKE '%coupon%' THEN 'no answer' END AS error FROM prompts""")
def answer_scripts(spark, d):
    """Every form page with a test case, its structure, retrieval, prompt and cleaned script."""
    chunks = materialize(_document_chunks(spark, d), "chunks")
    encoder = HashingEncoder.fit(chunks)
    pages = parse_pages(fixtures.form_pages(spark, d).select(F.col("page_id").alias("query_id"), "html"))
    items = read_table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("_item"), F.col("text").alias("query"))
    described = structure_context(pages).withColumn("_item", F.pmod("query_id", F.lit(max(1, items.count()))))
    described = described.join(asked, "_item").drop("_item")
    stored = materialize(encoder.encode(chunks), "encoded")
    return answers.generate_scripts(described, stored, encoder, stub_model).select(
        "query_id", "script", "structure_context", F.array_join("sources", "|").alias("sources"), "error"
    )


@query("usage_by_model", """
    SELECT event_type AS model, count(*) AS total_requests, sum(floor(value))::BIGINT AS total_tokens_used
    FROM events GROUP BY 1""")
def usage_by_model(spark, d):
    return generation.usage_stats(read_table(spark, d, "events"), F.col("event_type"), F.floor("value"))


@query("usage_since_reset", """
    SELECT event_type AS model, count(*) AS total_requests, sum(floor(value))::BIGINT AS total_tokens_used
    FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1""")
def usage_since_reset(spark, d):
    """Counts from the last reset on; the condition reaches the scan."""
    reset = F.col("ts") >= F.lit("2024-01-10 00:00:00").cast(read_table(spark, d, "events").schema["ts"].dataType)
    return generation.usage_stats(read_table(spark, d, "events"), F.col("event_type"), F.floor("value"), reset)


@query("request_rules", """
    SELECT conv_id, turn, array_to_string(list_filter([
               CASE WHEN length(text) < 10 THEN 'feature_description' END, CASE WHEN length(role) < 7 THEN 'feature_name' END,
               CASE WHEN length(text) < 20 THEN 'test_case' END, CASE WHEN turn NOT BETWEEN 1 AND 20 THEN 'top_k' END,
               CASE WHEN conv_id % 60 NOT BETWEEN 1 AND 50 THEN 'num_valid' END,
               CASE WHEN conv_id % 60 NOT BETWEEN 0 AND 50 THEN 'num_invalid' END], lambda x: x IS NOT NULL), ',') AS violations,
           NOT (length(text) < 10 OR length(role) < 7 OR length(text) < 20 OR turn NOT BETWEEN 1 AND 20
                OR conv_id % 60 NOT BETWEEN 1 AND 50) AS accepted
    FROM conversations""")
def request_rules(spark, d):
    """Turns as requests, with the rules they break."""
    share = F.col("conv_id") % 60
    rules = {
        "feature_description": requests.long_enough("feature_description", F.col("text")),
        "feature_name": requests.long_enough("feature_name", F.substring("role", 5, 100)),
        "test_case": requests.long_enough("test_case", F.col("text")),
        "top_k": requests.in_range("top_k", F.col("turn")),
        "num_valid": requests.in_range("num_valid", share),
        "num_invalid": requests.in_range("num_invalid", share),
    }
    return requests.check_requests(read_table(spark, d, "conversations"), rules).select(
        "conv_id", "turn", F.array_join("violations", ",").alias("violations"), "accepted"
    )
