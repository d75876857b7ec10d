import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_selectors import HTML

from domquill.operators import nodeset as N
from domquill.plans.compile import register, select
from domquill.plans.selector import SelectorError
from domquill.sources.html import load, nodes, parse_html, select_pages

SELECTORS = [
    "li", "*", "*#u1", ".a", ".first.a", "[href]", "li[href!=x]", 'li[href^=""]', "[title~=y]", "[rel|=x]", "[rel$=y]", '[rel*="-"]', "ul > li", "body b", "li + li", "ul ~ p", "li:nth-child(2)", "li:nth-child(odd)",
    "li:nth-child(-n+1)", "li:nth-last-child(1)", "li:nth-of-type(2n)", "input:nth-last-of-type(3)", "li:first-child", "b:only-child", "p:first-of-type", "p:last-of-type", "select:only-of-type", "li:eq(2)", "li:eq(-1)", "li:eq(9)", "li:gt(0)",
    "li:lt(-1)", "li:even", "li:odd", "li:first", "li:last", "ul li:first b", "ul:has(b)", "li:not(.a)", "li:not(ul#u1 > li)", "li:not(:first)", "li:contains('two!')", "li:lang(en)", "li:lang(de)", "#e:empty", ":root", "ul, p, li", "option:selected",
    ":checkbox", ":checked", ":input", ":text", ":button", ":disabled", ":enabled", ":header", "li:parent", ":submit", "form > input:not([disabled]) ~ select option", "body > *:has(li, option):not(form)",
]


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(3)
    tags = ["div", "p", "ul", "li", "b", "span", "input"]

    def soup():
        out = []
        for _ in range(r.randint(0, 60)):
            t = r.choice(tags)
            out.append(r.choice([f"<{t} class='{r.choice(['a', 'b a', ''])}'>", f"</{t}>", "text ", f"<{t} href={r.choice('xyz')}>", "<!-- c -->", "<script>x</script>"]))
        return "".join(out)

    rows = [(1, HTML), (2, None), (3, "")] + [(i, soup()) for i in range(4, 30)]
    return spark.createDataFrame(rows, "page_id int, html string").coalesce(2).cache()


@pytest.fixture(scope="module")
def stored(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nodes") / "n")
    nodes(pages).write.parquet(path)
    return spark.read.parquet(path)


def test_matching_in_the_pass_equals_the_plan_over_nodes(spark, pages, stored):
    got = select_pages(pages, {s: s for s in SELECTORS}).select("page_id", "node_id", F.explode("matched").alias("s")).collect()
    by = {s: {(x["page_id"], x["node_id"]) for x in got if x["s"] == s} for s in SELECTORS}
    want = None
    for s in SELECTORS:
        one = select(stored, s).select("page_id", "node_id", F.lit(s).alias("s"))
        want = one if want is None else want.unionByName(one)
    plain = {s: set() for s in SELECTORS}
    for x in want.collect():
        assert (x["page_id"], x["node_id"]) not in plain[x["s"]]
        plain[x["s"]].add((x["page_id"], x["node_id"]))
    assert by == plain and sum(map(bool, by.values())) > 50


def test_text_and_own_pseudos(pages, stored):
    got = {(r["page_id"], r["node_id"]): r["text_all"] for r in select_pages(pages, "ul").collect()}
    want = {(r["page_id"], r["node_id"]): r["text_all"] for r in N.texts(stored, select(stored, "ul")).collect()}
    assert got == want
    register("short-name", lambda _: F.length("tag") == 1)
    own = {(r["page_id"], r["node_id"], r["text_all"]) for r in select_pages(pages, ":short-name").collect()}
    assert own and own == {(r["page_id"], r["node_id"], r["text_all"]) for r in select_pages(pages, "b, p").collect()}
    with pytest.raises(SelectorError):
        select_pages(pages, "li:focus")


def test_load_reads_one_page(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "u", "<b>x</b>"), (2, "v", "<b>y</b>")], "page_id int, url string, html string").write.parquet(path)
    out = load(spark.read.parquet(path), "u b")
    assert [r["text_all"] for r in out.collect()] == ["x"]
    assert "EqualTo(url,u)" in out._jdf.queryExecution().executedPlan().toString()


def test_a_query_parses_pages_once(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n in ("find_links", "count_matches", "nav_child_links", "class_and_descendant", "has_contains", "lang_pseudo", "title_text", "nested_tests", "of_type", "universal_count") or n.startswith(("attr_", "positional_", "nth_", "selector_"))]
    assert len(names) > 15
    for n in names:
        plan = e.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan, n
    for n in ("closest_and_traverse", "set_algebra", "event_dispatch"):  # over a table of nodes
        assert e.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1, n


def test_scripts_go_in_linear_time():
    rows = parse_html("<p>" + "<b>x<script>y</script></b>" * 20_000)
    assert len(rows) == 40_001 and rows[0]["last"] == 40_000 and rows[-1]["parent_id"] == 39_999
    kept = parse_html("<div><script>a</script><i>b</i></div>")
    assert [(r["tag"], r["last"], r["elem_idx"] if r["kind"] == 1 else None) for r in kept] == [("div", 2, 1), ("i", 2, 1), (None, 2, None)]


def test_references_can_stay_as_they_stand():
    html = "<p class='a&amp;b' title=\"x&quot\">&ampc &lt;i&gt; \ue000&#65;</p><style>a&amp;b</style>"
    got = parse_html(html, references=False)
    assert (got[0]["attrs"], got[0]["classes"]) == ({"class": "a&amp;b", "title": "x&quot"}, ["a&amp;b"])
    assert [r["text"] for r in got if r["kind"] == 3] == ["&ampc &lt;i&gt; \ue000&#65;", "a&amp;b"]
    plain = parse_html(html)
    assert plain[0]["attrs"] == {"class": "a&b", "title": 'x"'} and plain[1]["text"] == "&c <i> \ue000A"
    assert [[r[k] for k in ("tag", "last", "kind")] for r in plain] == [[r[k] for k in ("tag", "last", "kind")] for r in got]


def test_title_text_equals_its_sql_on_odd_titles(spark, tmp_path):
    import __spark_entry__ as e

    titles = ["a&ampb &amp", "t = &quot;7&quo", "&lt;b&gt; &amp;lt; &amp;amp;&am", "&#65;&eacute;", "", "&&amp;&amp"]
    html = [f"<html><head><title>{t}</title><script>var t = '<title>no</title>'</script></head><p>x&amp;y</html>" for t in titles]
    html += [None, "", "<p>no title</p>", "<title>one</title><title>two</title>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(e.oracle_sql()["title_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = e.queries()["title_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 10
