import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.elements import read_page


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_strip_matches_python(spark):
    values = ["\x1c\x85 a　b  \t", " \xa0", "x", "", "​z"]
    assert column(spark, values, tx.strip(F.col("v"))) == [v.strip() for v in values]


def test_lines_match_python(spark):
    values = ["a\r\n b \x0bc\x1cd  e\n\n", "one", " \n "]
    expected = [[part.strip() for part in v.splitlines() if part.strip()] for v in values]
    assert column(spark, values, tx.lines(F.col("v"))) == expected


def test_decode_drops_bad_bytes_and_unifies_line_ends(spark):
    values = [b"a\r\nb\rc\n", b"\xff\xfeok\xc3", "é".encode(), b""]
    expected = ["a\nb\nc\n", "ok", "é", ""]
    assert column(spark, [bytearray(v) for v in values], tx.decode_text(F.col("v")), "binary") == expected


def test_pretty_json(spark):
    raw = [b'{"b": [1, 2.5, "\xc3\xa9"], "a": null}', b'{"a": 1', b'"\xff"', b"[]"]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(raw)], "i int, v binary")
    got = [r.p for r in rows.select("i", tx.pretty_json("v").alias("p")).orderBy("i").collect()]
    assert got[0].text == json.dumps(json.loads(raw[0]), indent=2, ensure_ascii=False) and got[0].error is None
    assert got[1].text is None and got[1].error
    assert got[2].text is None and got[2].error
    assert got[3].text == "[]"


PAGES = [
    "<h1>T</h1><p>one<br>two</p>",
    "<!DOCTYPE html><!-- c > d --><p title='a>b'>x &amp;lt; y &eacute;&#8364; &nbsp;</p><script>if (a<b) '</p>'</script>tail",
    "<style>p{}</style>a < b and c<b>d</b>e",
    "text<!-- x -->more<script>never closed <p>gone</p>",
    "  <div>\n  first \n second </div>",
    "",
]


def test_html_text(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    got = [r.t for r in tx.with_html_text(rows, "html", "t").orderBy("i").collect()]
    assert got == [
        "T\none\ntwo", "x &lt; y \xe9€\ntail", "a < b and c\nd\ne", "text\nmore", "first\nsecond", "",
    ]


def test_html_text_equals_the_text_nodes_of_the_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.t for r in tx.with_html_text(rows, "html", "t").collect()}
    for row in rows.collect():
        bare = read_page(row.html)["bare_text"]
        assert "".join(got[row.page_id].split("\n")) == bare.replace("\n", "")


@pytest.mark.parametrize("name,upload,parse", [
    ("a.TXT", True, True), ("a.xlsx", True, False), ("a.htm", False, True), ("a", False, False),
    (".md", True, False), ("dir.pdf/readme", False, False), ("x/y.tar.json", True, True), ("trailing.", False, False),
])
def test_extension_rules(spark, name, upload, parse):
    row = spark.createDataFrame([(name,)], "v string").select(
        tx.is_allowed_file(F.col("v")).alias("u"), tx.is_supported(F.col("v")).alias("p")
    ).first()
    assert (row.u, row.p) == (upload, parse)
