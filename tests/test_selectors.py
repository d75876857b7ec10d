import pytest
from pyspark.sql import functions as F

from domquill.operators import nodeset as N
from domquill.plans.compile import register, select
from domquill.plans.selector import SelectorError, nth, parse
from domquill.sources.html import nodes, parse_html

HTML = """<!DOCTYPE html><html lang="en-GB"><body>
<ul id="u1"><li class="a first">one</li><li class="b">two<b>!</b></li></ul>
<ul id="u2"><li href="">three</li><li rel="x-y">four</li></ul>
<p title="x y">text<p>more<br><div id="e"><!-- c --></div>
<form><input name="t" value="v"><input type="checkbox" name="c" checked><input type="radio" name="r">
<select name="s"><option value="1" selected>A</option><option selected>B</option></select>
<textarea name="ta">l1
l2</textarea><button>go</button><input name="off" disabled></form>
</body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id int, html string")).cache()


def labels(df):
    rows = df.orderBy("page_id", "node_id").select("tag", F.coalesce(F.try_element_at("attrs", F.lit("id")), F.lit("")).alias("id"), "elem_idx").collect()
    return [f"{r['tag']}{'#' + r['id'] if r['id'] else ''}:{r['elem_idx']}" for r in rows]


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("li", 4), ("*#u1", 1), (".a", 1), (".first.a", 1), ("[href]", 1), ("li[href!=x]", 4), ('li[href^=""]', 0), ("[title~=y]", 1), ("[rel|=x]", 1), ("[rel$=y]", 1), ('[rel*="-"]', 1),
        ("ul > li", 4), ("body b", 1), ("li + li", 2), ("ul ~ p", 2), ("li:nth-child(2)", 2), ("li:nth-child(odd)", 2), ("li:nth-child(-n+1)", 2), ("li:first-child", 2), ("b:only-child", 1),
        ("li:eq(2)", 1), ("li:eq(-1)", 1), ("li:gt(0)", 3), ("li:lt(-1)", 3), ("li:even", 2), ("li:first", 1), ("ul:has(b)", 1), ("li:not(.a)", 3), ("li:not(ul#u1 > li)", 2), ("li:contains('two!')", 1),
        ("li:lang(en)", 4), ("#e:empty", 1), (":root", 1), ("ul, p", 4), ("option:selected", 2), (":checkbox", 1), (":checked", 3), (":input", 7), (":text", 2), (":button", 1), (":disabled", 1), (":header", 0), ("li:parent", 4),
    ],
)
def test_selectors(page, selector, found):
    assert select(page, selector).count() == found


def test_positions_are_over_the_whole_set(page):
    assert labels(select(page, "li:eq(2)")) == ["li:1"]  # the second list's first


@pytest.mark.parametrize("bad", ["li:hover2", "li >", ", li", "li[", "li:nth-child(x)", "li:focus", "a:not(", "##x"])
def test_errors_come_before_any_job(bad):
    with pytest.raises(SelectorError):
        parse(bad)


def test_nth_and_escapes(page):
    assert nth("even") == (2, 0) and nth("-n+3") == (-1, 3) and nth("4") == (0, 4)
    assert parse(r"#a\.b")[0][0].tests[0].name == "a.b" and parse(r"#\31 x")[0][0].tests[0].name == "1x"
    register("short", lambda _: F.length("tag") == 1)
    assert select(page, ":short").count() == 3


def test_tree_closes_what_is_left_open():
    rows = [r for r in parse_html(HTML) if r["tag"] == "p"]
    assert [r["depth"] for r in rows] == [2, 2]
    assert not any(r["tag"] == "script" for r in parse_html("<p>a<script>1</script>b", keep_scripts=False))


def test_node_sets(page):
    li = select(page, "li")
    assert N.filter_(page, li, ".a").count() + N.not_(page, li, ".a").count() == li.count()
    assert N.add(li, li).count() == 4 and N.merge(li, li).count() == 8
    assert labels(N.slice_(li, -2)) == ["li:1", "li:2"] and labels(N.last(li)) == ["li:2"]
    assert N.traverse(page, select(page, "b"), "parents").count() == 4
    assert labels(N.traverse(page, select(page, "li.a"), "next_all")) == ["li:2"]
    assert labels(N.traverse_until(page, select(page, "b"), "parents", "body")) == ["ul#u1:1", "li:2"]
    assert N.closest(page, select(page, "b"), "ul, li").count() == 1
    assert N.text(page, select(page, "li.b")).first()["text"] == "two!"
    assert N.is_(page, li, ".a").first()["is"]
    assert N.has(page, select(page, "ul"), "b").count() == 1
    assert N.traverse(page, select(page, "li.b"), "contents").count() == 2


def test_form_fields(page):
    got = [(r["name"], r["value"]) for r in N.form_fields(page, select(page, "form")).orderBy("node_id").collect()]
    assert got == [("t", "v"), ("c", "on"), ("s", "1"), ("s", "B"), ("ta", "l1\r\nl2")]


def test_semi_joins_have_an_equal_key(page):
    plan = select(page, "ul > li, body b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
