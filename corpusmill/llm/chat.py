"""Conversations as one training string each, and back.

A conversation's rows are collected as structs and sorted; neighbours of the same role become one
block.  A block is ``<s>role[INST]text</s>``, with ``[/INST]`` between the texts of merged turns.
Control strings inside roles and texts lose their first character to ``~1`` or ``~2`` (and ``~``
becomes ``~0``), so a formatted string splits back into exactly the turns it was made of.

Nulls: a null role or text is empty; rows with a null conversation id are one conversation; a null
turn sorts first.  Rows of equal turn are ordered by role, then text, and repeated rows stay.  An
empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.registry import query
from corpusmill.session import read_table

OPEN, ROLE_END, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
CONTROL_TURN = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    for control, mark in ((CLOSE, "~2"), (OPEN, "~2"), (ROLE_END, "~1"), (NEXT, "~1")):
        text = F.replace(text, F.lit(control), F.lit(mark + control[1:]))
    return text


def unescape(text: Column) -> Column:
    for mark, char in (("~2", "<"), ("~1", "["), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def _split(text: Column, control: str) -> Column:
    return F.split(text, f"\\Q{control}\\E", -1)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, formatted)``; see the module for the template."""
    plain = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    rows = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    rows = rows.select("conv_id", "turns", starts.alias("starts"))
    blocks = F.transform("starts", lambda s, k: F.concat(
        F.lit(OPEN), escape(F.get("turns", s)["role"]), F.lit(ROLE_END),
        F.array_join(F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escape(t["text"])), NEXT),
        F.lit(CLOSE)))
    return rows.select("conv_id", F.array_join(blocks, "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) structs that a formatted string holds."""
    parts = _split(formatted, CLOSE)
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns(block: Column) -> Column:
        halves = _split(F.substring(block, F.lit(len(OPEN) + 1), F.length(block)), ROLE_END)
        role = unescape(F.get(halves, F.lit(0)))
        return F.transform(_split(F.get(halves, F.lit(1)), NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


_TEXT = "coalesce(text, '')"
_ESC = "replace(replace(replace(replace(replace({}, '~', '~0'), '</s>', '~2/s>'), '<s>', '~2s>'), '[INST]', '~1INST]'), '[/INST]', '~1/INST]')"
OP3_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {_TEXT} AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'),
marked AS (
  SELECT *, row_number() OVER w AS n, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('text')}) + CASE WHEN opens = 1 THEN 13 + length({_ESC.format('role')}) ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op3_chat_format", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, LEARNED_ROLE, CONTROL_TURN)], rows.schema)
    made = format_conversations(rows.unionAll(control))
    read = made.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNED_ROLE), lambda t: t["text"]), "")
    read = read.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), learned.alias("learned"))
    return read.select("conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
