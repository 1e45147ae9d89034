"""Page text and page structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import with_html_text
from corpusmill.operators import elements as el
from corpusmill.plans import fixtures
from corpusmill.plans.catalog.chunks import strip_sql
from corpusmill.plans.catalog.registry import query
from corpusmill.session import read_table, spread

# Markup without comments, scripts and styles.
QUIET = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g'), " \
        r"'(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(10), 'g')"


def decoded(text: str) -> str:
    """Entities of the given pages, with or without their semicolon; the ampersand last."""
    for name, code in [("lt", 60), ("gt", 62), ("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)]:
        text = rf"regexp_replace({text}, '&{name}(?:;|$|([^a-zA-Z0-9.;-]))', chr({code}) || '\1', 'g')"
    return text


def page_text_sql(quiet: str = QUIET) -> str:
    body = decoded(f"regexp_replace({quiet}, '<[^>]*>', chr(10), 'g')")
    line_list = f"list_transform(string_split({body}, chr(10)), lambda s: {strip_sql('s')})"
    return f"array_to_string(list_filter({line_list}, lambda s: s <> ''), chr(10))"


def _parsed(spark, d):
    return el.parse_pages(spread(read_table(spark, d, "pages").select("page_id", "html"), "page_id"))


def _parsed_forms(spark, d):
    return el.parse_pages(fixtures.form_pages(spark, d))


@query("html_text", f"SELECT page_id, {page_text_sql()} AS text FROM pages")
def html_text(spark, d):
    pages = spread(read_table(spark, d, "pages").select("page_id", "html"), "page_id")
    return with_html_text(pages, "html", "text").select("page_id", "text")


# Markup whose parts can be mistaken for each other, around values of the row.
HARD_PARTS = [
    "<p>", "url", "</p><script>if(a<!b){x('<p>')}</script><p title=it's>", "page_id", "</p><script>var s='<!--'</script><!-- <script> --><b>",
    "url", "</b><style>a > b {}</style><a title='x > y' href=\"<i>\">", "page_id", "</a><!DOCTYPE z><!-- open <p>lost",
]


@query("html_text_hard", """
    SELECT page_id, concat_ws(chr(10), url, page_id, url, page_id) AS text FROM pages""")
def html_text_hard(spark, d):
    """Scripts that look like comments, comments that look like scripts, odd quotes, a comment left open."""
    parts = [F.col(p).cast("string") if p in ("url", "page_id") else F.lit(p) for p in HARD_PARTS]
    pages = read_table(spark, d, "pages").select("page_id", F.concat(*parts).alias("html"))
    return with_html_text(pages, "html", "text").select("page_id", "text")


ELEMENT_SQL = rf"SELECT page_id, unnest(regexp_extract_all({QUIET}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages"


@query("html_elements", f"""
    SELECT page_id, lower(tag) AS tag, count(*) AS elements FROM (
        {ELEMENT_SQL}
        UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<(script|style)', 1)) FROM pages)
    GROUP BY 1, 2""")
def html_elements(spark, d):
    """Elements per page and tag."""
    tags = F.explode(F.transform("elements", lambda e: e["tag"]))
    return _parsed(spark, d).select("page_id", tags.alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


def _element_rows_sql() -> str:
    """Every element of the form pages: number, parent, last inside, form, tag, attributes and both texts."""
    n, save, see = "(CASE WHEN third THEN 1 ELSE 0 END)", "' Save ' || key", "'See ' || seg"
    rows = [  # number, parent, last, form, tag, attributes, text, stripped text
        ("0", "NULL", f"11 + {n}", "NULL", "html", "''", f"c_name || {save} || {see}", f"c_name || 'Save' || key || {see}"),
        ("1", "0", "2", "NULL", "head", "''", "c_name", "c_name"), ("2", "1", "2", "NULL", "title", "''", "c_name", "c_name"),
        ("3", "0", f"11 + {n}", "NULL", "body", "''", f"{save} || {see}", f"'Save' || key || {see}"),
        ("4", "3", f"8 + {n}", "NULL", "form", "'action=/c/' || key || ';class=wide card;id=f' || key || CASE WHEN c_custkey % 2 = 0 THEN ';method=post' ELSE '' END", save, "'Save' || key"),
        ("5", "4", "6", "4", "p", "''", "''", "''"),
        ("6", "5", "6", "4", "input", "'id=i' || key || ';name=' || lower(seg) || ';placeholder=n ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ';required=' ELSE '' END || ';type=text'", "''", "''"),
        (f"7 + {n}", "4", f"8 + {n}", "4", "button", "'class=b x' || c_nationkey || ';onclick=go(' || key || ')'", save, "'Save' || key"),
        (f"8 + {n}", f"7 + {n}", f"8 + {n}", "4", "b", "''", "key", "key"),
        (f"9 + {n}", "3", f"9 + {n}", "NULL", "img", "'src=a.png'", "''", "''"),
        (f"10 + {n}", "3", f"10 + {n}", "NULL", "a", "'class=nav;href=/n/' || c_nationkey", see, see),
        (f"11 + {n}", "3", f"11 + {n}", "NULL", "script", "''", "''", "''"),
    ]
    names = ("elem_idx", "parent_idx", "last_idx", "form_idx")
    line = lambda r: "SELECT c_custkey AS page_id, " + ", ".join(f"({v})::INT AS {c}" for v, c in zip(r, names)) + f", '{r[4]}' AS tag, {r[5]} AS attrs, {r[6]} AS text, {r[7]} AS text_stripped FROM pages_of"
    submit = line(("7", "4", "7", "4", "input", "'type=submit;value=Go ' || key", "''", "''")) + " WHERE third"
    return "WITH pages_of AS (SELECT *, c_custkey::VARCHAR AS key, c_mktsegment AS seg, c_custkey % 3 = 0 AS third FROM customer) " + " UNION ALL ".join([*map(line, rows), submit])


@query("html_element_table", _element_rows_sql())
def html_element_table(spark, d):
    """Every element with its place in the tree, the form around it, its attributes and both texts."""
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda a: F.concat(a["key"], F.lit("="), a["value"]))
    return el.element_table(_parsed_forms(spark, d)).select(
        "page_id", "elem_idx", "parent_idx", "last_idx", "form_idx", "tag", F.array_join(pairs, ";").alias("attrs"), "text", "text_stripped")


LINK_SQL = rf"SELECT page_id, unnest(regexp_extract_all({QUIET}, '(?s)<a\b[^>]*>.*?</a>')) AS a FROM pages"


def bare_sql(a: str) -> str:
    nodes = f"list_transform(string_split(regexp_replace({a}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda s: {strip_sql(decoded('s'))})"
    return f"array_to_string({nodes}, '')"


@query("html_links", f"""
    SELECT page_id, {decoded("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, {bare_sql('a')} AS text,
           count(*) AS times
    FROM ({LINK_SQL}) GROUP BY ALL""")
def html_links(spark, d):
    return el.links(_parsed(spark, d)).groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("times"))


@query("html_page_summary", rf"""
    SELECT page_id, {decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
           len(regexp_extract_all({QUIET}, '<input\b'))::BIGINT AS total_inputs,
           len(regexp_extract_all({QUIET}, '<button\b'))::BIGINT AS total_buttons,
           len(regexp_extract_all({QUIET}, '<form\b'))::BIGINT AS total_forms,
           len(regexp_extract_all({QUIET}, '<a\b'))::BIGINT AS total_links,
           len(regexp_extract_all({QUIET}, '<img\b'))::BIGINT AS total_images,
           html LIKE '%<script%' AS has_javascript
    FROM pages""")
def html_page_summary(spark, d):
    return el.page_summary(_parsed(spark, d))


@query("html_form_page_summary", """
    SELECT c_custkey AS page_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS total_inputs,
           CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS total_buttons, 1::BIGINT AS total_forms,
           1::BIGINT AS total_links, 1::BIGINT AS total_images, true AS has_javascript
    FROM customer""")
def html_form_page_summary(spark, d):
    return el.page_summary(_parsed_forms(spark, d))


@query("html_find_text", f"""
    WITH tags AS (
        SELECT page_id, 1 AS tag_order, 'a' AS tag, a AS part FROM ({LINK_SQL})
        UNION ALL SELECT page_id, 2, 'h1', unnest(regexp_extract_all({QUIET}, '(?s)<h1\\b[^>]*>.*?</h1>')) FROM pages)
    SELECT page_id, tag, {bare_sql('part')} AS text, count(*) AS times FROM tags
    WHERE contains(lower({decoded("regexp_replace(part, '<[^>]*>', '', 'g')")}), 'the') GROUP BY ALL""")
def html_find_text(spark, d):
    """Links and first-level headings that hold a word."""
    parsed = _parsed(spark, d)
    found = el.find_by_texts(parsed, [("THE", "a"), ("The", "h1")])
    return found.groupBy("page_id", "tag", "text").agg(F.count(F.lit(1)).alias("times"))


@query("html_find_default_tags", """
    SELECT c_custkey AS page_id, unnest([0, 1]) AS match_no, unnest(['button', 'a']) AS tag,
           unnest(['Save' || c_custkey, 'See ' || c_mktsegment]) AS text FROM customer""")
def html_find_default_tags(spark, d):
    """Default tags in list order: the button comes before the link."""
    return el.find_by_text(_parsed_forms(spark, d), "S").select(
        "page_id", "match_no", "tag", "text"
    )


INPUTS_SQL = """
    SELECT c_custkey AS page_id, 'text' AS type, 'i' || c_custkey AS id, lower(c_mktsegment) AS name,
           'n ' || c_nationkey AS placeholder, NULL AS value, c_custkey % 2 = 0 AS required FROM customer
    UNION ALL SELECT c_custkey, 'submit', NULL, NULL, NULL, 'Go ' || c_custkey, false FROM customer WHERE c_custkey % 3 = 0"""
BUTTONS_SQL = """
    SELECT c_custkey AS page_id, 'button' AS tag, 'button' AS type, 'Save' || c_custkey AS text,
           'go(' || c_custkey || ')' AS onclick, 'b x' || c_nationkey AS class FROM customer
    UNION ALL SELECT c_custkey, 'input', 'submit', 'Go ' || c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 0"""


@query("html_inputs", INPUTS_SQL)
def html_inputs(spark, d):
    return el.inputs(_parsed_forms(spark, d)).select("page_id", "type", "id", "name", "placeholder", "value", "required")


@query("html_buttons", BUTTONS_SQL)
def html_buttons(spark, d):
    return el.buttons(_parsed_forms(spark, d)).select(
        "page_id", "tag", "type", "text", "onclick", F.array_join("class", " ").alias("class")
    )


@query("html_forms", """
    SELECT c_custkey AS page_id, 'f' || c_custkey AS id, 'wide card' AS class, '/c/' || c_custkey AS action,
           CASE WHEN c_custkey % 2 = 0 THEN 'post' ELSE 'get' END AS method,
           CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS inputs,
           CASE WHEN c_custkey % 3 = 0 THEN 'Go ' || c_custkey || '|' ELSE '' END || 'Save' || c_custkey AS buttons
    FROM customer""")
def html_forms(spark, d):
    return el.forms(_parsed_forms(spark, d)).select(
        "page_id", "id", F.array_join("class", " ").alias("class"), "action", "method",
        F.size("inputs").cast("bigint").alias("inputs"),
        F.array_join(F.transform("buttons", lambda b: b["text"]), "|").alias("buttons"),
    )


@query("html_form_inputs", """
    SELECT c_custkey AS page_id, 'f' || c_custkey AS form_id, 'text' AS type, lower(c_mktsegment) AS name,
           '#i' || c_custkey AS css FROM customer
    UNION ALL SELECT c_custkey, 'f' || c_custkey, 'submit', NULL, 'input' FROM customer WHERE c_custkey % 3 = 0""")
def html_form_inputs(spark, d):
    """Inputs with the form around them."""
    return el.forms(_parsed_forms(spark, d)).select("page_id", F.col("id").alias("form_id"), F.explode("inputs").alias("i")).select(
        "page_id", "form_id", "i.type", "i.name", "i.selector.css"
    )


_SELECTOR_SQL = """
    SELECT c_custkey AS page_id, 'form' AS tag, 'f' || c_custkey AS id, NULL AS name, 'wide card' AS class FROM customer
    UNION ALL SELECT c_custkey, 'input', 'i' || c_custkey, lower(c_mktsegment), NULL FROM customer
    UNION ALL SELECT c_custkey, 'input', NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'button', NULL, NULL, 'b x' || c_nationkey FROM customer
    UNION ALL SELECT c_custkey, 'a', NULL, NULL, 'nav' FROM customer"""


def _selectors(spark, d):
    wanted = lambda e: e["tag"].isin("form", "input", "button", "a")
    picked = F.transform(F.filter("elements", wanted), lambda e: F.struct(e["tag"].alias("tag"), el.selector(e).alias("s")))
    return _parsed_forms(spark, d).select("page_id", F.explode(picked).alias("e")).select("page_id", "e.tag", "e.s.*")


@query("html_selectors", f"""
    SELECT page_id, tag, id, '#' || id AS css_id, name, '[name=''' || name || ''']' AS css_name, class,
           '.' || replace(class, ' ', '.') AS css_class FROM ({_SELECTOR_SQL})""")
def html_selectors(spark, d):
    return _selectors(spark, d).select("page_id", "tag", "id", "css_id", "name", "css_name", "class", "css_class")


@query("html_css_paths", f"""
    SELECT page_id, tag, coalesce('#' || id, tag || coalesce('.' || replace(class, ' ', '.'), '')) AS css
    FROM ({_SELECTOR_SQL})""")
def html_css_paths(spark, d):
    return _selectors(spark, d).select("page_id", "tag", "css")


@query("html_xpaths", f"""
    SELECT page_id, tag, CASE WHEN id IS NOT NULL THEN '//*[@id=''' || id || ''']'
                              WHEN name IS NOT NULL THEN '//' || tag || '[@name=''' || name || ''']'
                              ELSE '//' || tag END AS xpath
    FROM ({_SELECTOR_SQL})""")
def html_xpaths(spark, d):
    return _selectors(spark, d).select("page_id", "tag", "xpath")


STRUCTURE_SQL = """
    SELECT c_custkey AS page_id, concat_ws(chr(10), '=== PAGE SUMMARY ===', 'title: ' || c_name,
        'total_inputs: ' || n, 'total_buttons: ' || n, 'total_forms: 1', 'total_links: 1', 'total_images: 1',
        'has_javascript: True', '', '=== INPUT FIELDS ===',
        '- text input: id=''i' || c_custkey || ''', name=''' || lower(c_mktsegment) || ''', selector=''i' || c_custkey || '''',
        CASE WHEN n = 2 THEN '- submit input: id=''None'', name=''None'', selector=''input''' END, '', '=== BUTTONS ===',
        CASE WHEN n = 2 THEN '- Button ''Go ' || c_custkey || ''': id=''None'', selector=''input''' END,
        '- Button ''Save' || c_custkey || ''': id=''None'', selector=''button.b.x' || c_nationkey || '''', '') AS structure_context
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM customer)"""


@query("html_structure_context", STRUCTURE_SQL)
def html_structure_context(spark, d):
    return el.structure_context(_parsed_forms(spark, d))
