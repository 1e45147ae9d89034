"""Web pages to element arrays, and structure queries over them.

Parsing is the only Python step.  It turns a page into one struct: its text (twice: as it stands
and with every text node stripped), its title and an array with one entry per element.  An element
points into the two texts, so nesting does not multiply the output.  Elements are numbered in document
order, and ``last_idx`` is the number of the last one inside, so "inside" is a range of numbers.
Structure queries are column expressions inside the page's row, none of them shuffles, also when one
page is huge; those that need the text of many elements cut it in Python, where a cut costs what it holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.text import named_character
from corpusmill.operators.rows import in_slices, unnest

# --- fixed values -----------------------------------------------------------------------------
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
]
KEEP_BLANKS_TAGS = ["pre", "textarea"]
SILENT_TAGS = ["script", "style", "template"]
BUTTON_INPUT_TYPES = ["button", "submit"]
TEXT_SEARCH_TAGS = ["button", "a", "span", "div", "p", "h1", "h2", "h3", "label"]
MARKUP_SPACES = " \n\t\x0c\r"
# ----------------------------------------------------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())
ELEMENT_TYPE = T.StructType([
    T.StructField("elem_idx", T.IntegerType()),
    T.StructField("parent_idx", T.IntegerType()),
    T.StructField("last_idx", T.IntegerType()),
    T.StructField("form_idx", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", _STRINGS),
    *[T.StructField(c, T.IntegerType()) for c in ("text_from", "text_to", "bare_from", "bare_to")],
])
PAGE_TYPE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("page_text", T.StringType()),
    T.StructField("bare_text", T.StringType()),
    T.StructField("elements", T.ArrayType(ELEMENT_TYPE)),
])
_PAGE_ARROW = to_arrow_type(PAGE_TYPE)


class _PageReader(HTMLParser):
    """Collects elements and text offsets while the standard parser walks a page.

    Void tags close at once; an end tag closes everything up to the nearest open tag of its name
    and is ignored when there is none; tags left open end with the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.elements: list[dict] = []
        self.open: list[int] = []
        self.open_tags: Counter[str] = Counter()  # what is open, so that no step walks the open tags
        self.open_forms: list[int] = []
        self.silent = self.keeping = 0
        self.text, self.bare = [], []
        self.text_len = self.bare_len = 0
        self.pending: list[str] = []
        self.children: dict[int, list] = {}

    def _flush(self) -> None:
        if not self.pending:
            return
        node, self.pending = "".join(self.pending), []
        if not node.strip(MARKUP_SPACES) and not self.keeping:
            node = "\n" if "\n" in node else " "
        if self.open:
            self.children[self.open[-1]].append(node)
        if self.silent:
            return
        stripped = node.strip()
        self.text.append(node)
        self.bare.append(stripped)
        self.text_len += len(node)
        self.bare_len += len(stripped)

    def handle_starttag(self, tag, attrs):
        self._flush()
        index = len(self.elements)
        values = {name: "" if value is None else value for name, value in attrs}
        self.elements.append({
            "elem_idx": index,
            "parent_idx": self.open[-1] if self.open else None,
            "last_idx": index,
            "form_idx": self.open_forms[-1] if self.open_forms else None,
            "tag": tag,
            "attrs": list(values.items()),
            "classes": values["class"].split() if "class" in values else None,
            "text_from": self.text_len, "text_to": self.text_len,
            "bare_from": self.bare_len, "bare_to": self.bare_len,
        })
        self.children[index] = []
        if self.open:
            self.children[self.open[-1]].append(index)
        if tag not in VOID_TAGS:
            self.open.append(index)
            self._count(tag, index, 1)

    def _count(self, tag: str, index: int, step: int) -> None:
        self.open_tags[tag] += step
        self.silent += step * (tag in SILENT_TAGS)
        self.keeping += step * (tag in KEEP_BLANKS_TAGS)
        if tag == "form":
            self.open_forms.append(index) if step > 0 else self.open_forms.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def _close_last(self):
        element = self.elements[self.open.pop()]
        self._count(element["tag"], element["elem_idx"], -1)
        element["text_to"], element["bare_to"] = self.text_len, self.bare_len
        element["last_idx"] = len(self.elements) - 1

    def handle_endtag(self, tag):
        self._flush()
        if self.open_tags[tag]:
            while self.elements[self.open[-1]]["tag"] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(named_character(name))

    def handle_charref(self, name):
        self.pending.append(unescape(f"&#{name};"))

    def _break(self, _=None):
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _break

    def _title(self) -> str | None:
        """Text of the first title element if it is one single text node, also inside tags."""
        node = next((e["elem_idx"] for e in self.elements if e["tag"] == "title"), None)
        while isinstance(node, int):
            inner = self.children[node]
            node = inner[0] if len(inner) == 1 else None
        return node

    def read(self, markup: str) -> dict:
        self.feed(markup)
        self.close()
        self._flush()
        while self.open:
            self._close_last()
        return {
            "title": self._title(), "page_text": "".join(self.text), "bare_text": "".join(self.bare),
            "elements": self.elements,
        }


def read_page(markup: str) -> dict:
    return _PageReader().read(markup)


@F.arrow_udf(PAGE_TYPE)
def parse_page(markup: pa.Array) -> pa.Array:
    """Page struct of every markup text; NULL for NULL."""
    return in_slices([markup], _PAGE_ARROW, lambda pages: [None if m is None else read_page(m) for m in pages])


def parse_pages(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``pages`` with ``title, page_text, bare_text, elements`` in place of the markup."""
    rest = [c for c in pages.columns if c != markup]
    return pages.select(*rest, parse_page(F.col(markup)).alias("_page")).select(*rest, "_page.*")


# ---- columns of one element -------------------------------------------------------------------


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def has_attr(e: Column, name: str) -> Column:
    return F.map_contains_key(e["attrs"], name)


def element_text(e: Column, page_text: Column | None = None) -> Column:
    """All text inside the element, as it stands."""
    text = F.col("page_text") if page_text is None else page_text
    return F.substring(text, e["text_from"] + 1, e["text_to"] - e["text_from"])


def element_bare_text(e: Column, bare_text: Column | None = None) -> Column:
    """All text inside the element, every text node stripped."""
    text = F.col("bare_text") if bare_text is None else bare_text
    return F.substring(text, e["bare_from"] + 1, e["bare_to"] - e["bare_from"])


def _given(value: Column) -> Column:
    """The value, or NULL when it is missing or empty."""
    return F.nullif(value, F.lit(""))


def _dotted(e: Column) -> Column:
    return F.when(F.size(e["classes"]) > 0, F.array_join(e["classes"], "."))


def css_path(e: Column) -> Column:
    """``#id``, else the tag with its classes."""
    by_class = F.concat(e["tag"], F.coalesce(F.concat(F.lit("."), _dotted(e)), F.lit("")))
    return F.coalesce(F.concat(F.lit("#"), _given(attr(e, "id"))), by_class)


def xpath(e: Column) -> Column:
    """By id, else by tag and name, else by tag."""
    return F.coalesce(
        F.concat(F.lit("//*[@id='"), _given(attr(e, "id")), F.lit("']")),
        F.concat(F.lit("//"), e["tag"], F.lit("[@name='"), _given(attr(e, "name")), F.lit("']")),
        F.concat(F.lit("//"), e["tag"]),
    )


def selector(e: Column) -> Column:
    """Every way to address the element; parts that do not apply are NULL."""
    by_id, by_name = _given(attr(e, "id")), _given(attr(e, "name"))
    return F.struct(
        by_id.alias("id"), F.concat(F.lit("#"), by_id).alias("css_id"),
        by_name.alias("name"), F.concat(F.lit("[name='"), by_name, F.lit("']")).alias("css_name"),
        F.when(F.size(e["classes"]) > 0, F.array_join(e["classes"], " ")).alias("class"),
        F.concat(F.lit("."), _dotted(e)).alias("css_class"),
        css_path(e).alias("css"), xpath(e).alias("xpath"),
    )


def is_button(e: Column) -> Column:
    """Button tags of any type, and inputs of exactly the two button types."""
    kind = F.coalesce(attr(e, "type"), F.lit(""))
    return (e["tag"] == "button") | ((e["tag"] == "input") & kind.isin(BUTTON_INPUT_TYPES))


def _input_row(e: Column) -> Column:
    return F.struct(
        e["elem_idx"].alias("elem_idx"), e["tag"].alias("tag"),
        F.coalesce(attr(e, "type"), F.lit("text")).alias("type"),
        attr(e, "id").alias("id"), attr(e, "name").alias("name"), e["classes"].alias("class"),
        attr(e, "placeholder").alias("placeholder"), attr(e, "value").alias("value"),
        has_attr(e, "required").alias("required"), selector(e).alias("selector"),
    )


def _button_text(e: Column) -> Column:
    return F.when(e["tag"] == "button", element_bare_text(e)).otherwise(attr(e, "value"))


def _button_row(e: Column) -> Column:
    return F.struct(
        e["elem_idx"].alias("elem_idx"), e["tag"].alias("tag"),
        F.coalesce(attr(e, "type"), F.lit("button")).alias("type"),
        attr(e, "id").alias("id"), e["classes"].alias("class"), _button_text(e).alias("text"),
        attr(e, "onclick").alias("onclick"), selector(e).alias("selector"),
    )


def _form_row(e: Column) -> Column:
    inside = F.slice(F.col("elements"), e["elem_idx"] + 2, e["last_idx"] - e["elem_idx"])
    inputs = F.transform(F.filter(inside, lambda x: x["tag"] == "input"), lambda x: F.struct(
        F.coalesce(attr(x, "type"), F.lit("text")).alias("type"), attr(x, "id").alias("id"),
        attr(x, "name").alias("name"), selector(x).alias("selector"),
    ))
    buttons = F.transform(F.filter(inside, is_button), lambda x: F.struct(
        F.coalesce(attr(x, "type"), F.lit("button")).alias("type"), attr(x, "id").alias("id"),
        _button_text(x).alias("text"), selector(x).alias("selector"),
    ))
    return F.struct(
        e["elem_idx"].alias("elem_idx"), attr(e, "id").alias("id"), e["classes"].alias("class"),
        attr(e, "action").alias("action"), F.coalesce(attr(e, "method"), F.lit("get")).alias("method"),
        selector(e).alias("selector"), inputs.alias("inputs"), buttons.alias("buttons"),
    )


def _link_row(e: Column) -> Column:
    return F.struct(
        e["elem_idx"].alias("elem_idx"), e["tag"].alias("tag"), attr(e, "id").alias("id"),
        e["classes"].alias("class"), attr(e, "href").alias("href"), element_bare_text(e).alias("text"),
        selector(e).alias("selector"),
    )


# ---- tables ----------------------------------------------------------------------------------


def _rows(parsed: DataFrame, wanted, row) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("title", "page_text", "bare_text", "elements")]
    picked = F.transform(F.filter(F.col("elements"), wanted), row)
    return unnest(parsed, rest, picked, "_n", "_row").select(*rest, "_row.*")


_TEXTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("text_stripped", T.StringType())]))


@F.arrow_udf(_TEXTS)
def _cut_texts(page_text: pa.Array, bare_text: pa.Array, spans: pa.Array) -> pa.Array:
    """Both texts of every element of a page; ``spans`` holds the four offsets."""
    def cut(*columns: list) -> list:
        return [None if each is None else [{"text": text[a:b], "text_stripped": bare[c:d]} for a, b, c, d in each] for text, bare, each in zip(*columns, strict=True)]

    return in_slices([page_text, bare_text, spans], to_arrow_type(_TEXTS), cut)


def element_table(parsed: DataFrame) -> DataFrame:
    """One row per element with its text, in document order per page; ``form_idx`` is the form around it.

    Texts are cut before the elements become rows, so a row carries its own text and no copy of the page.
    """
    rest = [c for c in parsed.columns if c not in ("title", "page_text", "bare_text", "elements")]
    spans = F.transform("elements", lambda e: F.array(e["text_from"], e["text_to"], e["bare_from"], e["bare_to"]))
    cut = parsed.select(*rest, "elements", _cut_texts("page_text", "bare_text", spans).alias("_texts"))
    both = F.zip_with("elements", "_texts", lambda e, t: F.struct(
        *[e[c].alias(c) for c in ("elem_idx", "parent_idx", "last_idx", "form_idx", "tag", "attrs", "classes")], t["text"].alias("text"), t["text_stripped"].alias("text_stripped")))
    return unnest(cut, rest, both, "_n", "e").select(*rest, "e.*")


def inputs(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, lambda e: e["tag"] == "input", _input_row)


def buttons(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, is_button, _button_row)


def forms(parsed: DataFrame) -> DataFrame:
    """One row per form with the inputs and buttons inside it, at any depth."""
    return _rows(parsed, lambda e: e["tag"] == "form", _form_row)


def links(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, lambda e: e["tag"] == "a", _link_row)


_HITS = T.ArrayType(T.StructType([
    T.StructField("search_no", T.IntegerType()), T.StructField("match_no", T.IntegerType()), T.StructField("elem_idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
]))


def _places(lower: str, needle: str) -> list[int]:
    """Where ``needle`` begins, overlapping occurrences included."""
    found, at = [], lower.find(needle)
    while at != -1:
        found.append(at)
        at = lower.find(needle, at + 1)
    return found


def _lowered(text: str) -> str:
    """Lower case with every character in its place."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _search(tags_of: list[list[str]]):
    """Hits of each search in a page: its text is lowered and searched once per needle, an element asks for its range."""

    def find(*columns: list) -> list:
        made = []
        for text, bare, names, each, wanted in zip(*columns, strict=True):
            if each is None:
                made.append(None)
                continue
            lower, by_tag, found = _lowered(text), {}, []
            for i, name in enumerate(names):
                by_tag.setdefault(name, []).append(i)
            places: dict[str, list[int]] = {}
            for number, needle in enumerate(wanted):
                if needle is None:
                    continue
                needle, match = _lowered(needle), 0
                if needle not in places:
                    places[needle] = _places(lower, needle) if needle else []
                for name in tags_of[number]:
                    for i in by_tag.get(name, ()):
                        a, b, c, d = each[i]
                        at = bisect_left(places[needle], a)
                        if not needle or (at < len(places[needle]) and places[needle][at] + len(needle) <= b):
                            found.append({"search_no": number, "match_no": match, "elem_idx": i, "text": bare[c:d]})
                            match += 1
            made.append(found)
        return made

    @F.arrow_udf(_HITS)
    def hits(page_text: pa.Array, bare_text: pa.Array, tags: pa.Array, spans: pa.Array, needles: pa.Array) -> pa.Array:
        return in_slices([page_text, bare_text, tags, spans, needles], to_arrow_type(_HITS), find)

    return hits


def find_by_texts(parsed: DataFrame, searches: list[tuple[str | Column, str | None]]) -> DataFrame:
    """Elements that hold a text in any case, for several ``(text, tag)`` at once; no tag means the usual ones.

    ``search_no`` numbers the searches, ``match_no`` the hits of one search by tag list and document order.
    """
    tags_of = [[tag] if tag else TEXT_SEARCH_TAGS for _, tag in searches]
    needles = F.array(*[F.lit(text) if isinstance(text, str) else text for text, _ in searches])
    rest = [c for c in parsed.columns if c not in ("title", "page_text", "bare_text", "elements")]
    spans = F.transform("elements", lambda e: F.array(e["text_from"], e["text_to"], e["bare_from"], e["bare_to"]))
    tags = F.transform("elements", lambda e: e["tag"])
    hits = parsed.select(*rest, "elements", _search(tags_of)("page_text", "bare_text", tags, spans, needles).alias("_hits"))

    def shown(hit: Column) -> Column:
        e = F.get("elements", hit["elem_idx"])
        return F.struct(hit["search_no"].alias("search_no"), hit["match_no"].alias("match_no"), hit["elem_idx"].alias("elem_idx"), e["tag"].alias("tag"),
                        hit["text"].alias("text"), attr(e, "id").alias("id"), e["classes"].alias("class"), selector(e).alias("selector"))

    return unnest(hits, rest, F.transform("_hits", shown), "_n", "_row").select(*rest, "_row.*")


def find_by_text(parsed: DataFrame, text: str | Column, tag: str | None = None) -> DataFrame:
    """Elements whose text holds ``text`` in any case, numbered by tag list and document order."""
    return find_by_texts(parsed, [(text, tag)]).drop("search_no")


def _count(wanted) -> Column:
    return F.size(F.filter(F.coalesce(F.col("elements"), F.array().cast(T.ArrayType(ELEMENT_TYPE))), wanted)).cast("bigint")


def page_summary(parsed: DataFrame) -> DataFrame:
    """Title and counts of every page."""
    rest = [c for c in parsed.columns if c not in ("title", "page_text", "bare_text", "elements")]
    return parsed.select(
        *rest, "title",
        _count(lambda e: e["tag"] == "input").alias("total_inputs"),
        _count(is_button).alias("total_buttons"),
        _count(lambda e: e["tag"] == "form").alias("total_forms"),
        _count(lambda e: e["tag"] == "a").alias("total_links"),
        _count(lambda e: e["tag"] == "img").alias("total_images"),
        (_count(lambda e: e["tag"] == "script") > 0).alias("has_javascript"),
    )


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def structure_context(parsed: DataFrame) -> DataFrame:
    """Text that lists a page's summary, inputs and buttons with their best selectors."""
    rest = [c for c in parsed.columns if c not in ("title", "page_text", "bare_text", "elements")]
    summary = page_summary(parsed.withColumn("_elements", F.col("elements")).withColumn("_bare", F.col("bare_text")))
    summary = summary.withColumnsRenamed({"_elements": "elements", "_bare": "bare_text"})
    truth = F.when(F.col("has_javascript"), "True").otherwise("False")
    names = ["total_inputs", "total_buttons", "total_forms", "total_links", "total_images"]
    head = F.array(
        F.lit("=== PAGE SUMMARY ==="), F.concat(F.lit("title: "), _shown(F.col("title"))),
        *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names],
        F.concat(F.lit("has_javascript: "), truth), F.lit(""),
    )

    def section(title: str, wanted, line) -> Column:
        found = F.transform(F.filter(F.col("elements"), wanted), line)
        none = F.array().cast("array<string>")
        return F.when(F.size(found) > 0, F.concat(F.array(F.lit(title)), found, F.array(F.lit("")))).otherwise(none)

    def input_line(e: Column) -> Column:
        best = F.coalesce(_given(attr(e, "id")), _given(attr(e, "name")), css_path(e))
        return F.concat(
            F.lit("- "), F.coalesce(attr(e, "type"), F.lit("text")), F.lit(" input: id='"), _shown(attr(e, "id")),
            F.lit("', name='"), _shown(attr(e, "name")), F.lit("', selector='"), best, F.lit("'"),
        )

    def button_line(e: Column) -> Column:
        best = F.coalesce(_given(attr(e, "id")), css_path(e))
        return F.concat(
            F.lit("- Button '"), _shown(_button_text(e)), F.lit("': id='"), _shown(attr(e, "id")),
            F.lit("', selector='"), best, F.lit("'"),
        )

    body = F.concat(
        head,
        section("=== INPUT FIELDS ===", lambda e: e["tag"] == "input", input_line),
        section("=== BUTTONS ===", is_button, button_line),
    )
    return summary.select(*rest, F.array_join(body, "\n").alias("structure_context"))
