"""Text columns: stripping, decoding, file names, markup to text."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# --- fixed values -----------------------------------------------------------------------------
# Characters a Python ``str.strip`` removes (Unicode white space plus the four separators).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends that a Python ``str.splitlines`` knows.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# Extensions accepted for upload, and those with a text extractor.  The lists differ on purpose:
# a spreadsheet may be uploaded but has no extractor, "htm" is the reverse.
UPLOAD_EXTENSIONS = ["txt", "md", "json", "pdf", "html", "docx", "xlsx"]
PARSER_EXTENSIONS = ["txt", "md", "json", "pdf", "html", "htm", "docx"]
# ----------------------------------------------------------------------------------------------

# Named references that the JVM path decodes itself; a text with any other one goes to Python.
_NATIVE_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0",
    "copy": "\xa9", "reg": "\xae", "middot": "\xb7", "hellip": "\u2026",
    "ndash": "\u2013", "mdash": "\u2014",
}
_OTHER_REFERENCE = rf"&(?!(?:amp|{'|'.join(_NATIVE_ENTITIES)});)[#a-zA-Z]"

# Whatever begins first wins: a comment inside a script is script, a tag inside a comment is comment.
_MARKUP = "(?is)" + "|".join([
    r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)",
    r"<!--.*?(?:-->|\z)",
    r"<![^>]*>|<\?[^>]*>",
    # a quote opens a value only behind an equals sign
    r"""</?[a-z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""",
])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def lines(text: Column) -> Column:
    """Stripped, non-blank lines as an array."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


@F.arrow_udf(T.StringType())
def _utf8_ignore(content: pa.Array) -> pa.Array:
    return pa.array(
        [None if b is None else b.decode("utf-8", "ignore") for b in content.to_pylist()],
        pa.string(),
    )


def decode_text(content: Column) -> Column:
    """Bytes to text: undecodable bytes dropped, every line end turned into ``\\n``.

    Valid UTF-8 (the normal case) is decoded in the JVM; only rows with broken bytes are shipped
    to Python, because the built-in repair function replaces such bytes instead of dropping them.
    """
    valid = F.is_valid_utf8(content.cast("string"))
    repaired = _utf8_ignore(F.when(~valid, content))
    return universal_newlines(F.when(valid, content.cast("string")).otherwise(repaired))


PARSED_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.arrow_udf(PARSED_TEXT)
def pretty_json(content: pa.Array) -> pa.Array:
    """Strict UTF-8 JSON re-emitted with a two-space indent, or the reason why it is not JSON."""

    def one(raw):
        if raw is None:
            return None
        try:
            value = json.loads(raw.decode("utf-8"))
            text = json.dumps(value, indent=2, ensure_ascii=False)
            text.encode("utf-8")  # a lone surrogate is legal JSON but no text
            return {"text": text, "error": None}
        except (ValueError, RecursionError) as problem:
            return {"text": None, "error": str(problem)}

    return pa.array([one(raw) for raw in content.to_pylist()], to_arrow_type(PARSED_TEXT))


_REFERENCE = re.compile(r"&(?:(#[xX][0-9a-fA-F]+|#[0-9]+)|([a-zA-Z][-.a-zA-Z0-9]*));?")


def named_character(name: str) -> str:
    """Character of a named reference; an unknown name stays, without its semicolon."""
    return html5.get(f"{name};", f"&{name}")


def resolve_references(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(f"&{m[1]};") if m[1] else named_character(m[2]), text)


@F.arrow_udf(T.StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else resolve_references(t) for t in text.to_pylist()], pa.string())


def with_unescaped(df: DataFrame, text: str) -> DataFrame:
    """Character references in column ``text`` to characters.

    Rows with common references only stay in the JVM; the others go to Python.
    """
    common = F.col(text)
    for name, char in _NATIVE_ENTITIES.items():
        common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
    common = F.replace(common, F.lit("&amp;"), F.lit("&"))
    staged = df.withColumn("_rare", F.when(F.col(text).rlike(_OTHER_REFERENCE), F.col(text)))
    decoded = F.when(F.col("_rare").isNull(), common).otherwise(_unescape(F.col("_rare")))
    return staged.withColumn(text, decoded).drop("_rare")


def with_html_text(df: DataFrame, markup: str, out: str) -> DataFrame:
    """Add the visible text of a page: one stripped, non-blank line per line of a text node.

    Built in stages, as columns of their own, so that no stage is computed twice.
    """
    decoded = with_unescaped(df.withColumn(out, F.regexp_replace(F.col(markup), _MARKUP, "\n")), out)
    return decoded.withColumn(out, F.array_join(lines(F.col(out)), "\n"))


def upload_extension(filename: Column) -> Column:
    """Lower-case text behind the last dot; NULL without a dot."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))


def is_allowed_file(filename: Column) -> Column:
    return F.coalesce(upload_extension(filename).isin(UPLOAD_EXTENSIONS), F.lit(False))


def suffix(path: Column) -> Column:
    """Lower-case path suffix with its dot; a leading or trailing dot makes no suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def is_supported(path: Column) -> Column:
    return F.ltrim(suffix(path), F.lit(".")).isin(PARSER_EXTENSIONS)
