"""Reading, merging and storing documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.encoders import HashingEncoder
from corpusmill.functions.vectors import unit
from corpusmill.operators.chunking import chunk_table, fixed_chunks
from corpusmill.plans import fixtures, ingest
from corpusmill.plans.answers import retrieve
from corpusmill.plans.catalog.chunks import strip_sql, windows_sql
from corpusmill.plans.catalog.pages import page_text_sql
from corpusmill.plans.catalog.registry import query
from corpusmill.session import materialize, read_table, scratch_dir, spread
from corpusmill.sources import files, knowledge_base as kbs, parts

NEWLINES = r"regexp_replace(body, '\r\n?', chr(10), 'g')"
GOOD_JSON = """'{' || chr(10) || '  "k": ' || json_extract_string(body, '$.k') || chr(10) || '}'"""
PARSED_MIXED_SQL = f"""
    SELECT path, CASE WHEN kind IN ('txt', 'md') THEN {NEWLINES}
                      WHEN kind = 'json' AND body NOT LIKE '{{{{%' THEN {GOOD_JSON}
                      WHEN kind = 'html' THEN html_text ELSE '' END AS text,
           kind IN ('txt', 'md', 'html') OR (kind = 'json' AND body NOT LIKE '{{{{%') AS success,
           CASE WHEN kind IN ('pdf', 'xlsx') THEN 'Unsupported file format: .' || kind END AS refused
    FROM (SELECT *, lower(string_split(path, '.')[-1]) AS kind, {page_text_sql().replace("html,", "body,")} AS html_text
          FROM ({fixtures.MIXED_SQL}))"""


def _parsed(spark, d):
    return files.parse_files(fixtures.mixed_files(spark, d))


@query("src_parse_mixed", PARSED_MIXED_SQL)
def src_parse_mixed(spark, d):
    """Texts, pages, JSON (some broken) and unsupported files in one pass."""
    refused = F.when(F.startswith(F.col("error"), F.lit("Unsupported")), F.col("error"))
    return _parsed(spark, d).select("path", "text", "success", refused.alias("refused"))


@query("src_parse_summary", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed
    FROM ({PARSED_MIXED_SQL})""")
def src_parse_summary(spark, d):
    return files.parse_summary(_parsed(spark, d))


@query("src_missing", f"""
    SELECT r.path, coalesce(p.success, false) AS success,
           CASE WHEN p.path IS NULL THEN 'File not found: ' || r.path END AS absent
    FROM (SELECT path FROM ({fixtures.MIXED_SQL}) UNION ALL SELECT 'n/' || n_name || '.txt' FROM nation) r
    LEFT JOIN ({PARSED_MIXED_SQL}) p USING (path)""")
def src_missing(spark, d):
    """Requested paths, some of which do not exist."""
    wanted = read_table(spark, d, "nation").select(F.concat(F.lit("n/"), "n_name", F.lit(".txt")).alias("path"))
    requested = fixtures.mixed_files(spark, d).select("path").unionByName(wanted)
    absent = F.when(F.startswith(F.col("error"), F.lit("File not found")), F.col("error"))
    return files.with_missing(requested, _parsed(spark, d)).select("path", "success", absent.alias("absent"))


@query("src_decode", r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, ' ', chr(13) || chr(10), 'g'), '\r\n?', chr(10), 'g') AS text FROM documents""")
def src_decode(spark, d):
    """Bytes with Windows line ends and a broken byte; the byte goes, the line ends become one kind."""
    raw = F.concat(F.replace("text", F.lit(" "), F.lit("\r\n")).cast("binary"), F.unhex(F.lit("FF")))
    return read_table(spark, d, "documents").select("doc_id", tx.decode_text(raw).alias("text"))


@query("src_pretty_json", f"SELECT event_id, {GOOD_JSON} AS text FROM (SELECT event_id, props AS body FROM events)")
def src_pretty_json(spark, d):
    pretty = tx.pretty_json(F.col("props").cast("binary"))
    return read_table(spark, d, "events").select("event_id", pretty["text"].alias("text"))


@query("src_pages", """
    SELECT conv_id, string_agg('--- Page ' || turn + 1 || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY turn) AS text
    FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '  ' ELSE text END AS t FROM conversations)
    WHERE trim(t) <> '' GROUP BY conv_id""")
def src_pages(spark, d):
    """Turns as pages; blank pages are skipped but keep their number."""
    pages = read_table(spark, d, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("page_no"),
        F.when(F.col("turn") % 4 == 2, "  ").otherwise(F.col("text")).alias("text"),
    )
    return parts.join_pages(pages, "conv_id", "page_no")


@query("src_parts", """
    SELECT conv_id, string_agg(text, chr(10) ORDER BY kind, turn) AS text
    FROM (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS kind FROM conversations)
    WHERE trim(text) <> '' GROUP BY conv_id""")
def src_parts(spark, d):
    """Paragraphs first, then table cells."""
    rows = read_table(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "assistant", 1).otherwise(0))
    return parts.join_parts(rows, "conv_id", "kind", ["turn"])


@query("src_direct_text", """
    SELECT conv_id || '-' || turn AS doc_key, role AS source, 'direct_text' AS type, text FROM conversations
    WHERE length(trim(text)) >= 10""")
def src_direct_text(spark, d):
    rows = read_table(spark, d, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return files.direct_text(rows, "text", "key", "role").select("doc_key", "source", "type", "text")


@query("src_scan", f"""
    SELECT filename, octet_length(encode(body)) AS n_bytes, '.' || lower(string_split(filename, '.')[-1]) AS extension, true AS success,
           md5({NEWLINES}) AS text_md5 FROM ({fixtures.PAGE_FILES_SQL})""")
def src_scan(spark, d):
    """A folder with a file per page, hidden and empty ones included: listed, read, parsed."""
    found = files.parse_files(files.scan_files(spark, fixtures.page_folder(spark, d)))
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("n_bytes"), tx.suffix(F.col("path")).alias("extension"),
        "success", F.md5("text").alias("text_md5"))


@query("src_scan_ingest", f"""
    SELECT filename AS file_name, {strip_sql(NEWLINES)} <> '' AS success, CASE WHEN {strip_sql(NEWLINES)} = '' THEN '{ingest.NO_TEXT}' END AS error
    FROM ({fixtures.PAGE_FILES_SQL})""")
def src_scan_ingest(spark, d):
    """The same folder ingested: what became of every file."""
    folder = fixtures.page_folder(spark, d)
    kb = kbs.KnowledgeBase(spark, scratch_dir(spark, "kb"), dimension=16)
    return ingest.ingest_directory(spark, folder, kb, encoder=HashingEncoder([1.0] * 16)).results.select("file_name", "success", "error")


_NAMES_SQL = """
    SELECT page_id, unnest([url, 'Scan.' || page_id || '.PDF', 'table.xlsx', 'old.htm', 'noextension' || page_id, 'dir.md/readme']) AS name
    FROM pages"""


def _names(spark, d):
    number = F.col("page_id").cast("string")
    names = F.array(
        F.col("url"), F.concat(F.lit("Scan."), number, F.lit(".PDF")), F.lit("table.xlsx"), F.lit("old.htm"),
        F.concat(F.lit("noextension"), number), F.lit("dir.md/readme"),
    )
    return read_table(spark, d, "pages").select("page_id", F.explode(names).alias("name"))


@query("filter_upload", f"""
    SELECT page_id, name FROM ({_NAMES_SQL}) WHERE name LIKE '%.%'
    AND lower(string_split(name, '.')[-1]) IN ('txt', 'md', 'json', 'pdf', 'html', 'docx', 'xlsx')""")
def filter_upload(spark, d):
    return _names(spark, d).filter(tx.is_allowed_file(F.col("name")))


@query("filter_supported", f"""
    SELECT page_id, name FROM ({_NAMES_SQL})
    WHERE lower(regexp_extract(string_split(name, '/')[-1], '\\.([^.]+)$', 1)) IN ('txt', 'md', 'json', 'pdf', 'html', 'htm', 'docx')""")
def filter_supported(spark, d):
    return _names(spark, d).filter(tx.is_supported(F.col("name")))


@query("set_formats", f"""
    SELECT page_id, string_agg(DISTINCT e, ',' ORDER BY e) AS formats
    FROM (SELECT page_id, lower(regexp_extract(name, '\\.([a-zA-Z]+)$', 1)) AS e FROM ({_NAMES_SQL}))
    WHERE e NOT IN ('', 'pdf', 'docx') GROUP BY page_id""")
def set_formats(spark, d):
    """Formats per page without those that have no library."""
    found = F.collect_set(F.lower(F.regexp_extract("name", r"\.([a-zA-Z]+)$", 1)))
    missing = F.array(F.lit(""), *[F.lit(e) for e in files.LIBRARY_EXTENSIONS])
    kept = F.array_sort(F.array_except(found, missing))
    return _names(spark, d).groupBy("page_id").agg(F.array_join(kept, ",").alias("formats"))


@query("set_concat", """
    SELECT 'document' AS origin, doc_id AS id, text, lang FROM documents
    UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark""")
def set_concat(spark, d):
    """Bag union of two text tables with different columns."""
    docs = read_table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text", "lang")
    items = read_table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    return docs.unionByName(items, allowMissingColumns=True)


@query("set_distinct", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def set_distinct(spark, d):
    return read_table(spark, d, "documents").select(F.nullif("source", F.lit("")).alias("source")).dropna().distinct()


@query("meta_merge", """
    SELECT doc_id, 'api' AS source, lang, CASE WHEN doc_id % 2 = 0 THEN 'yes' END AS reviewed,
           CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n_keys FROM documents""")
def meta_merge(spark, d):
    """File metadata overridden and extended by given metadata."""
    base = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")
    given = F.when(
        F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("api"), F.lit("reviewed"), F.lit("yes"))
    ).otherwise(F.create_map(F.lit("source"), F.lit("api")))
    merged = read_table(spark, d, "documents").select("doc_id", files.merge_metadata(base, given).alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return merged.select("doc_id", value("source"), value("lang"), value("reviewed"), F.size("m").cast("bigint").alias("n_keys"))


# ---- knowledge base --------------------------------------------------------------------------


def _kb_rows(spark, d):
    return fixtures.chunks(spark, d).select(
        F.col("doc_key").cast("string").alias("doc_key"), "chunk_id", "text", "filename", "source",
        F.coalesce(unit(F.col("embedding")), "embedding").alias("embedding"),
    )


def _stored(spark, d, rows=None):
    kb = kbs.KnowledgeBase(spark, scratch_dir(spark, "kb"), dimension=64)
    kb.add(_kb_rows(spark, d) if rows is None else rows)
    return kb


@query("kb_store", f"""
    SELECT doc_key::VARCHAR AS doc_key, chunk_id::BIGINT AS chunk_id, text, filename, source,
           round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm
    FROM ({fixtures.CHUNKS_SQL})""")
def kb_store(spark, d):
    """Chunks with vectors stored, then loaded."""
    length = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return _stored(spark, d).load().select(
        "doc_key", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text", "filename", "source", F.round(length, 4).alias("norm")
    )


_KB_STATS = """
    SELECT {times} * count(*) AS total_vectors, max(len(embedding))::BIGINT AS embedding_dim,
           {times} * count(*) AS metadata_count, 1000::BIGINT AS chunk_size, 200::BIGINT AS chunk_overlap, true AS index_exists
    FROM (""" + fixtures.CHUNKS_SQL + ")"


@query("kb_stats", _KB_STATS.replace("{times}", "1"))
def kb_stats(spark, d):
    """Stored twice; the second load changes nothing."""
    rows = materialize(_kb_rows(spark, d), "kb-rows")
    kb = _stored(spark, d, rows)
    kb.add(rows)
    return kb.stats()


@query("kb_append_copies", _KB_STATS.replace("{times}", "2"))
def kb_append_copies(spark, d):
    """Stored twice with copies kept."""
    rows = materialize(_kb_rows(spark, d), "kb-rows")
    kb = _stored(spark, d, rows)
    kb.add(rows, mode="append")
    return kb.stats()


@query("kb_clear", _KB_STATS.replace("{times}", "1") + " WHERE doc_key % 2 = 0")
def kb_clear(spark, d):
    """Stored, cleared, and half of it stored again."""
    rows = materialize(_kb_rows(spark, d), "kb-rows")
    kb = _stored(spark, d, rows)
    kb.clear(confirm=True)
    kb.add(rows.where(F.col("doc_key").cast("bigint") % 2 == 0))
    return kb.stats()


@query("kb_retrieve_copies", f"""
    WITH chunks AS MATERIALIZED ({fixtures.CHUNKS_SQL}),
    copies AS (SELECT * FROM chunks UNION ALL SELECT * FROM chunks),
    pairs AS (
        SELECT q.vec_id AS query_id, c.doc_key::VARCHAR AS doc_key, c.text, power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
        FROM embeddings q CROSS JOIN copies c)
    SELECT query_id, row_number() OVER w AS rank, doc_key, round(distance, 5) AS distance, length(text) AS n_chars FROM pairs
    WINDOW w AS (PARTITION BY query_id ORDER BY round(distance, 9), doc_key) QUALIFY row_number() OVER w <= 6""")
def kb_retrieve_copies(spark, d):
    """Every chunk stored twice: each copy is a hit of its own and brings its text."""
    kb = kbs.KnowledgeBase(spark, scratch_dir(spark, "kb"), dimension=64)
    rows = materialize(fixtures.chunks(spark, d).select(F.col("doc_key").cast("string").alias("doc_key"), "chunk_id", "text", "embedding"), "kb-rows")
    kb.add(rows, mode="append")
    kb.add(rows, mode="append")
    hits = retrieve(fixtures.vector_queries(spark, d), kb.load(), 6)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_key", F.round("distance", 5).alias("distance"),
                       F.length("text").cast("bigint").alias("n_chars"))


def _as_files(docs):
    return docs.select(F.col("doc_id").cast("string").alias("doc_key"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), "source", "text",
                       F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


_FIRST_SQL = windows_sql(1000, 200)
_SECOND = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Revised.' ELSE '' END AS text FROM documents WHERE doc_id % 3 <> 2)"
_SECOND_SQL = windows_sql(1000, 200, _SECOND)


def _reingested(spark, d):
    """All documents stored; then a third of them longer, a third of them empty, and the rest not named again."""
    kb = kbs.KnowledgeBase(spark, scratch_dir(spark, "kb"), dimension=64)
    encoder = HashingEncoder([1.0] * 64)
    docs = spread(read_table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    ingest.ingest_documents(_as_files(docs), kb, encoder, separators=[""])
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Revised."))).otherwise("")
    done = ingest.ingest_documents(_as_files(docs.where(F.col("doc_id") % 3 != 2).withColumn("text", text)), kb, encoder, separators=[""])
    return kb, done


@query("kb_reingest_changed", f"""
    SELECT doc_id::VARCHAR AS doc_key, chunk_id::BIGINT AS chunk_id, total_chunks::BIGINT AS total_chunks, md5(text) AS text_md5
    FROM (SELECT * FROM ({_SECOND_SQL}) UNION ALL SELECT * FROM ({_FIRST_SQL}) WHERE doc_id % 3 = 2)""")
def kb_reingest_changed(spark, d):
    """Changed documents keep only their new chunks, emptied ones lose theirs, the others keep theirs."""
    return _reingested(spark, d)[0].load().select(
        "doc_key", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("total_chunks").cast("bigint").alias("total_chunks"), F.md5("text").alias("text_md5"))


@query("ingest_repeat_summary", f"""
    WITH old AS ({_FIRST_SQL}), new AS ({_SECOND_SQL}), docs AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM new) AS good FROM {_SECOND})
    SELECT count(*) AS total_files, count(*) FILTER (WHERE good) AS successful, count(*) FILTER (WHERE NOT good) AS failed,
           (SELECT count(*) FROM new WHERE NOT EXISTS (FROM old WHERE old.doc_id = new.doc_id AND old.chunk_id = new.chunk_id AND old.text = new.text)) AS total_chunks
    FROM docs""")
def ingest_repeat_summary(spark, d):
    """Totals of the second load: only chunks that were not stored yet count as added."""
    return _reingested(spark, d)[1].summary


@query("kb_metadata", f"SELECT doc_key::VARCHAR AS doc_key, filename, source, length(text) AS n_chars FROM ({fixtures.CHUNKS_SQL})")
def kb_metadata(spark, d):
    return _stored(spark, d).metadata().select("doc_key", "filename", "source", F.length("text").cast("bigint").alias("n_chars"))


@query("kb_consistency", """
    SELECT count(d.doc_id) AS vector_count, count(l.doc_id) AS metadata_count,
           count(*) FILTER (WHERE l.doc_id IS NULL) AS vectors_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS metadata_only,
           count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS consistent
    FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def kb_consistency(spark, d):
    return kbs.consistency(read_table(spark, d, "documents"), read_table(spark, d, "labels"), ["doc_id"])


# ---- ingest ----------------------------------------------------------------------------------


def _ingested(spark, d):
    parsed = _parsed(spark, d).select(
        F.col("path").alias("doc_key"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit(None).cast("string").alias("source"), "text", "success", "error",
    )
    return ingest.chunked(parsed, separators=[""])


RESULTS_SQL = f"""
    SELECT p.path AS file_name, p.success AND count(c.chunk_id) > 0 AS success, count(c.chunk_id) AS chunks_added,
           any_value(p.refused) AS refused
    FROM ({PARSED_MIXED_SQL}) p LEFT JOIN ({windows_sql(1000, 200, f"({PARSED_MIXED_SQL})", "path")}) c USING (path)
    GROUP BY p.path, p.success"""


@query("ingest_results", RESULTS_SQL)
def ingest_results(spark, d):
    """Status and number of chunks (character windows) of every file."""
    refused = F.when(F.startswith(F.col("error"), F.lit("Unsupported")), F.col("error")).alias("refused")
    return ingest.file_results(_ingested(spark, d), F.col("doc_key")).select("file_name", "success", "chunks_added", refused)


@query("ingest_summary", f"""
    SELECT count(*) AS total_files, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
           sum(chunks_added) FILTER (WHERE success)::BIGINT AS total_chunks
    FROM ({RESULTS_SQL})""")
def ingest_summary(spark, d):
    return ingest.ingest_summary(ingest.file_results(_ingested(spark, d), F.col("doc_key")))


@query("ingest_direct_results", f"""
    SELECT d.doc_id::VARCHAR AS file_name, count(c.chunk_id) AS chunks_added
    FROM documents d LEFT JOIN ({windows_sql(1000, 200)}) c USING (doc_id) GROUP BY d.doc_id""")
def ingest_direct_results(spark, d):
    """Direct texts cut in character windows: chunks per text."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    chunks = chunk_table(docs, fixed_chunks(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks_added"))
    return docs.select("doc_id").join(chunks, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("file_name"), F.coalesce("chunks_added", F.lit(0).cast("bigint")).alias("chunks_added")
    )
