import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import elements as el
from corpusmill.operators import rows

PAGE = """<!DOCTYPE html><html><head><title>Shop &amp; more</title><script>var a = "<input>";</script></head><body>
<form id="login" class="box wide" action="/in"><div><input id="u" name="user" required placeholder="Name">
<input type="password" name="pw" value=""><input type="submit" value="Go"></div></form>
<form><button class="x" type="reset"> Clear <b>all</b> </button></form>
<input type="SUBMIT" name="q"><a href="/home" class="nav top">Home <i>page</i></a><img src="a.png"><p>un<!-- c -->closed
</body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    return el.parse_pages(spark.createDataFrame([(1, PAGE), (2, ""), (3, "<a>x<a>y</b></a>")], "page_id int, html string")).cache()


def test_inputs(parsed):
    rows = el.inputs(parsed).orderBy("elem_idx").collect()
    assert [(r.type, r.id, r.name, r.placeholder, r.value, r.required) for r in rows] == [
        ("text", "u", "user", "Name", None, True), ("password", None, "pw", None, "", False),
        ("submit", None, None, None, "Go", False), ("SUBMIT", None, "q", None, None, False),
    ]
    assert rows[0].selector.css == "#u" and rows[0].selector.xpath == "//*[@id='u']"
    assert rows[1].selector.css == "input" and rows[1].selector.xpath == "//input[@name='pw']"
    assert rows[1].selector.css_name == "[name='pw']"


def test_buttons_and_forms(parsed):
    buttons = el.buttons(parsed).orderBy("elem_idx").collect()
    assert [(r.tag, r.type, r.text) for r in buttons] == [("input", "submit", "Go"), ("button", "reset", "Clearall")]
    forms = el.forms(parsed).orderBy("elem_idx").collect()
    assert [(f.id, f.action, f.method, len(f.inputs), [b.text for b in f.buttons]) for f in forms] == [
        ("login", "/in", "get", 3, ["Go"]), (None, None, "get", 0, ["Clearall"]),
    ]
    assert forms[0].selector["class"] == "box wide" and forms[0].selector.css_class == ".box.wide"


def test_links_and_search(parsed):
    rows = el.links(parsed).orderBy("page_id", "elem_idx").collect()
    assert [(r.page_id, r.href, r.text) for r in rows] == [(1, "/home", "Homepage"), (3, None, "xy"), (3, None, "y")]
    found = el.find_by_text(parsed, "HOME P").collect()
    assert [(r.page_id, r.tag, r.text) for r in found] == [(1, "a", "Homepage")]
    assert el.find_by_text(parsed, "page", "i").count() == 1
    assert el.find_by_text(parsed, "unclosed").first().tag == "p"


def test_summary_and_context(parsed):
    rows = {r.page_id: r for r in el.page_summary(parsed).collect()}
    assert tuple(rows[1])[1:] == ("Shop & more", 4, 2, 2, 1, 1, True)
    assert tuple(rows[2])[1:] == (None, 0, 0, 0, 0, 0, False)
    context = {r.page_id: r.structure_context for r in el.structure_context(parsed).collect()}
    assert "- text input: id='u', name='user', selector='u'" in context[1].split("\n")
    assert "- password input: id='None', name='pw', selector='pw'" in context[1].split("\n")
    assert "- Button 'Clearall': id='None', selector='button.x'" in context[1].split("\n")
    assert context[2].endswith("has_javascript: False\n")


def test_tree_rules():
    page = el.read_page("<ul><li>a<li>b</ul></p><br/>c<pre>\n \n</pre><p class=''>&unknown;&lt;</p>")
    tags = [(e["tag"], e["parent_idx"]) for e in page["elements"]]
    assert tags == [("ul", None), ("li", 0), ("li", 1), ("br", None), ("pre", None), ("p", None)]
    assert page["page_text"] == "abc\n \n&unknown<" and page["bare_text"] == "abc&unknown<"
    assert page["elements"][5]["classes"] == []
    assert el.read_page("<title>a<b>c</b></title>")["title"] is None
    assert el.read_page("<title><b>c</b></title>")["title"] in ("c", "<b>c</b>")


def test_element_table(parsed):
    rows = {(r.page_id, r.elem_idx): r for r in el.element_table(parsed).collect()}
    assert rows[(3, 0)].text == "xy" and rows[(3, 1)].text_stripped == "y" and rows[(3, 1)].parent_idx == 0
    assert all(r.text_stripped.replace("\n", "") for r in rows.values() if r.tag == "title")


def test_ranges_and_many_forms(spark):
    page = el.read_page("<form><p><input></p><form><input></form></form><b>x</b>")["elements"]
    assert [(e["tag"], e["last_idx"], e["form_idx"]) for e in page] == [("form", 4, None), ("p", 2, 0), ("input", 2, 0), ("form", 4, 0), ("input", 4, 3), ("b", 5, None)]
    many = "".join(f"<form id=f{i}><input name=a{i}><button>go {i}</button></form>" for i in range(2000))
    pages = el.parse_pages(spark.createDataFrame([(1, many)], "page_id int, html string")).cache()
    pages.count()
    started = time.time()
    rows = el.forms(pages).collect()
    assert len(rows) == 2000 and all(len(r.inputs) == 1 and r.buttons[0].text.startswith("go") for r in rows)
    table = {r.elem_idx: r for r in el.element_table(pages).collect()}
    assert time.time() - started < 15 and table[3].tag == "form" and table[4].form_idx == 3 and table[5].text == "go 1"
    nested = el.read_page("<form>" * 3000 + "<input>")["elements"]
    assert nested[0]["last_idx"] == 3000 and nested[-1]["form_idx"] == 2999


def test_several_searches_at_once(spark, parsed):
    found = el.find_by_texts(parsed, [("HOME P", None), ("page", "i"), ("nothing", None), ("", "img")]).collect()
    assert sorted((r.search_no, r.match_no, r.page_id, r.tag, r.text) for r in found) == [(0, 0, 1, "a", "Homepage"), (1, 0, 1, "i", "page"), (3, 0, 1, "img", "")]
    odd = el.parse_pages(spark.createDataFrame([(1, "<p>\u0130x \u0130STANBUL</p><p>aaab</p>", "AAB"), (2, None, "x"), (3, "<p>x</p>", None)], "page_id int, html string, word string"))
    assert [(r.page_id, r.text) for r in el.find_by_text(odd, F.col("word")).collect()] == [(1, "aaab")]
    assert el.find_by_text(odd, "stanbul").count() == 1


def test_values_of_few_pages_are_in_python_at_once(monkeypatch):
    read, alive, most = el.read_page, [], []

    def reading(markup):
        alive.append(markup)
        return read(markup)

    pages = pa.array([PAGE, None, "", PAGE * 40, PAGE] * 10)
    made = rows.in_slices([pages], el._PAGE_ARROW, lambda part: most.append(sum(len(p or "") for p in part)) or [None if p is None else reading(p) for p in part], limit=20_000)
    assert made.equals(pa.array([None if p is None else read(p) for p in pages.to_pylist()], el._PAGE_ARROW))
    assert len(alive) == 40 and max(most) <= 20_000 + 41 * len(PAGE) and len(most) > 10
    assert el.parse_page.func(pages).equals(made)
    assert rows.in_slices([pa.array([], pa.string())], pa.string(), list).equals(pa.array([], pa.string()))


def test_a_batch_of_pages_takes_little_more_than_its_result():
    page = "<p>" + "<b class='x'>y</b>" * 60
    pages = pa.array([page] * 4000)
    tracemalloc.start()
    made = el.parse_page.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 4000 and peak < 90 << 20  # all elements at once took 185 MB
