"""License statements in documents, with built-in functions only.

Two answers are given per document.  *Base* phrases are places where given words stand consecutively.
*Blocks* (each line with the lines behind it, ``BLOCK_LINES`` in all, so that a statement wrapped over so many lines
is met) are matched to license templates by an exact set-similarity join: a block belongs to a template when it holds at least ``threshold`` of the template's distinct words, whatever their order and
whatever else it says.

Template words are ordered by the number of documents of the whole corpus that hold them, rare ones first.
A template of ``n`` words that needs ``k`` of them is filed under its first ``n - k + 1`` words only (prefix
filter); a block of fewer than ``k`` words is not asked (length filter); at a shared prefix word the words
that follow in either bound what can still be shared (positional filter).  Survivors are verified in full.
Templates are a parameter of bounded size, so their index is broadcast; texts are never shuffled.

Nulls: null text is an empty text; null ids keep their own result.  Repeated rows give repeated result rows.
Very long texts are read whole, within their row.  Of templates that tie, every one counts; labels are sorted.
Empty tables give an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents
from corpusmill.llm.registry import query
from corpusmill.session import materialize

# Word pattern, base phrases with their labels, templates with theirs.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)
THRESHOLD = 0.8
BLOCK_LINES = 3
MAX_TEMPLATES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The two letters beyond ASCII whose small form is ASCII, and letters to stand for them.
ODD = (("\u212a", "\u0138"), ("\u0130", "\u0131"))


def lowered(text: Column) -> Column:
    """``text`` with small A-Z; other letters may change too but never become or stop being ASCII."""
    text = F.coalesce(text, F.lit(""))
    for odd, other in ODD:
        text = F.replace(text, F.lit(odd), F.lit(other))
    return F.lower(text)


def cut_words(text: Column) -> Column:
    """What lies between the characters that are in no word; the ends may be empty."""
    return F.split(text, NO_WORD)


def inner_words(parts: Column) -> Column:
    """``cut_words`` without empty ends."""
    head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase; positions are only walked in documents that hold all its words."""
    want = phrase.split()
    here = lambda i: F.get(words, i) == want[0]
    test = lambda i: [F.get(words, i + k) == w for k, w in enumerate(want[1:], 1)]

    def match(i):
        hit = here(i)
        for more in test(i):
            hit = hit & more
        return hit

    holds = F.array_contains(words, want[-1])
    for w in want[:-1]:
        holds = holds & F.array_contains(words, w)
    return F.when(holds, F.filter(F.sequence(F.lit(0), F.size(words) - 1), match)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def template_index(held: DataFrame, templates, threshold: float) -> list[tuple[int, str, list[str], int]]:
    """``(number, label, words in global order, words needed)`` of each template.

    ``held(held)`` has the distinct template words of every document; all documents are counted.
    """
    rows = held.select(F.explode("held").alias("w")).groupBy("w").count().collect()
    seen = {r["w"]: r["count"] for r in rows}  # at most one row per template word
    return [(number, label, sorted(words, key=lambda w: (seen.get(w, 0), w)), need) for number, label, words, need in _needs(templates, threshold)]


def _needs(templates, threshold: float) -> list[tuple[int, str, list[str], int]]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError("template tables of this size need a shuffled join")
    words = [(number, label, sorted(set(text.split()))) for number, (text, label) in enumerate(templates)]
    return [(number, label, w, next(k for k in range(1, len(w) + 1) if k >= threshold * len(w) - 1e-9)) for number, label, w in words]


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _blocks(low: Column) -> Column:
    """Every line joined with the lines behind it."""
    lines = F.split(low, "\n")
    joined = lines
    for behind in range(1, BLOCK_LINES):
        joined = F.zip_with(joined, F.slice(lines, behind + 1, F.size(lines)), lambda a, b: F.concat_ws(" ", a, b))  # the last lines have none behind
    return joined


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES,
                 threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(documents, blocks)``.

    documents: ``doc_id, text_key, n_words, places array<struct<start, label>>``; blocks: ``doc_id,
    text_key, block, template, label, containment`` for every block that meets a template, named by its first line.
    ``text_key`` tells apart rows that share an id.
    """
    spark = docs.sparkSession
    needs = _needs(templates, threshold)
    vocabulary = sorted({w for _, _, words, _ in needs for w in words})
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), lowered(F.col(text)).alias("low"))
    parts = plain.withColumn("parts", cut_words(F.col("low")))
    worded = parts.select("doc_id", "text_key", "low", inner_words(F.col("parts")).alias("words"))
    worded = worded.select("*", F.array_intersect(_literal(vocabulary), "words").alias("held"))
    places = F.concat(*[_labelled(_places(F.col("words"), phrase), label) for phrase, label in phrases])
    # a block holds no more of a template than its whole document does
    able = F.lit(False)
    for _, _, words, need in needs:
        able = able | (F.size(F.array_intersect(_literal(words), F.col("held"))) >= need)
    lines = F.when(able, F.transform(_blocks(F.col("low")), lambda block: F.array_distinct(F.filter(cut_words(block), lambda w: w != ""))))
    made = materialize(worded.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "held", places.alias("places"), lines.alias("blocks")), "licenses")

    index = template_index(made, templates, threshold)
    filed = spark.createDataFrame(
        [(w, at, number, label, order, need) for number, label, order, need in index for at, w in enumerate(order[:len(order) - need + 1])],
        "word string, at int, template int, label string, template_words array<string>, need int")
    blocks = made.where(F.col("blocks").isNotNull()).select("doc_id", "text_key", F.posexplode("blocks").alias("block", "words"))
    blocks = blocks.select("doc_id", "text_key", "block", F.size("words").alias("size"), F.array_intersect("words", _literal(vocabulary)).alias("held"))
    probes = blocks.select("*", F.explode("held").alias("word"))
    met = probes.join(F.broadcast(filed), "word").where(F.col("size") >= F.col("need"))  # length
    # words before the first shared one are not in the block, so this many can still be shared
    first = F.array_position(F.transform("template_words", lambda w: F.array_contains("held", w)), F.lit(True)) - 1
    met = met.where(F.col("at") == first).where(F.size("template_words") - F.col("at") >= F.col("need"))  # positional
    shared = F.size(F.array_intersect("template_words", "held"))
    verified = met.withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    verified = verified.select("doc_id", "text_key", "block", "template", "label", (F.col("shared") / F.size("template_words")).alias("containment"))
    return made.drop("blocks", "held"), verified


def _phrase_sql(phrase: str, label: str) -> str:
    want = phrase.split()
    test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(want, 1))
    return f"list_transform(list_filter(range(0, len(w)), lambda i: {test}), lambda i: {{'start': i, 'label': '{label}'}})"


_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', ['" + "', '".join(sorted(set(text.split()))) + "'])" for i, (text, label) in enumerate(TEMPLATES))
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
worded AS (SELECT r, doc_id, regexp_extract_all(t, '{_SQL_WORD}') AS w FROM rows),
based AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, list_concat({', '.join(_phrase_sql(p, label) for p, label in PHRASES[:2])}) AS p1, {_phrase_sql(*PHRASES[2])} AS p2 FROM worded),
placed AS (SELECT r, doc_id, n_words, list_concat(p1, p2) AS p FROM based),
templates(template, label, words) AS (VALUES {_TEMPLATE_ROWS}),
lined AS (SELECT r, string_split(t, chr(10)) AS ls FROM rows),
blocks AS (
  SELECT r, list_distinct(regexp_extract_all(array_to_string(ls[i:i + {BLOCK_LINES - 1}], ' '), '{_SQL_WORD}')) AS b
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM lined)),
met AS (
  SELECT r, label, len(list_intersect(words, b)) / len(words) AS c FROM blocks, templates
  WHERE len(list_intersect(words, b)) >= {THRESHOLD} * len(words) - 1e-9),
found AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(p, lambda x: x.start)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.start)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
  CAST(CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS DOUBLE) AS score
FROM placed LEFT JOIN found USING (r)
"""


@query("op4_license_scan", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, blocks = license_scan(documents(spark, sf_dir))
    found = blocks.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    rows = docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    rows = rows.select("d.doc_id", "n_words", "places", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, "found")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("containment")).alias("score"))
