"""Queries that put one operator each to rows of its own, or to the driver's tables, with SQL that
gives the same rows. What SQL says of own rows follows from the operator's rule, not from its code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import nodeset as N
from .operators import rows as R
from .plans.compile import register, select
from .plans.selector import SelectorError, parse
from .queries import found, page_nodes, query, table
from .session import written
from .sources import feeds
from .sources.html import load, nodes, parse_html, select_pages
from .streaming import events as E

C, L = F.col, F.lit


def literal(x) -> str:
    if x is None:
        return "NULL"
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], **types: str) -> str:
    """SQL for the given rows, with columns of the given types."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    columns = ", ".join(f"{c}::{t} AS {c}" for c, t in types.items())
    return f"SELECT {columns} FROM (VALUES {body}) AS t({', '.join(types)})"


def case(name: str, schema: str, rows: list[tuple], out: Callable[[], Column], kind: str, expected: list) -> None:
    """A query (id, out) of a function on own rows, and what it gives for each."""

    @query(name, values(list(enumerate(expected)), id="int", out=kind))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}").select("id", out().alias("out"))


def texts(name: str, given: list[str | None], out: Callable[[Column], Column], expected: list, kind: str = "varchar") -> None:
    case(name, "s string", [(x,) for x in given], lambda: out(C("s")), kind, expected)


# Text

texts("camel_case", ["font-size", "-ms-foo-bar", "a-1b", "plain", "-webkit-x", None], S.camel_case, ["fontSize", "msFooBar", "a1b", "plain", "WebkitX", None])
texts("decamelize", ["fooBar", "aBCd", "x"], S.decamelize, ["foo-bar", "a-b-cd", "x"])
texts("newline_to_br", ["a\nb\n\nc", "", None], S.newline_to_br, ["a<br>b<br><br>c", "", None])
texts("cook", ["<a><b>", "a > b", "&", "plain"], S.cook_quirk, ["&lt;a&gt><b>", "a &gt> b", "&", "plain"])
texts("width_escape", ["a&b", "<x> y", "a\tb c"], S.width_escape, ["a&amp;b", "&lt;x&gt; y", "a b c"])
texts("tag_trim", ["  a b ", " x﻿", "", None], S.tag_trim, ["a b", "x", "", None])
texts("not_blank", ["a", "  ", "", " b ", None], S.not_blank, ["a", None, None, " b ", None])
texts("strip_tag_suffix", ["x_tag", "tag", "a_tag_tag", "_tags"], S.strip_tag_suffix, ["x", "tag", "a_tag", "_tags"])
texts("strip_close_mark", ["one  x", "one  x", "box", "x"], S.strip_close_mark, ["one", "one", "box", "x"])
texts("anchor_fragment", ["http://x/y#z", "#a", "no", "a#b c", "a#b#c"], S.anchor_fragment, ["#z", "#a", "no", "a#b c", "#c"])
texts("strip_returns", ["a\r\nb\r", "c"], S.strip_returns, ["a\nb", "c"])
texts("to_crlf", ["a\nb\r\nc", "d"], S.to_crlf, ["a\r\nb\r\nc", "d"])
texts("fill_template", ["{{ a }}{{ a }}-{{ b }}", "{{a}}", "none"], lambda s: S.fill_template(s, {"a": L("1"), "b": L("$1")}), ["1{{ a }}-$1", "{{a}}", "none"])
texts("linkify_cases", ["see HTTP://a.b/c?d=e now", "@bob and x@y, #tag", "https://t.co/x", "a\n@b", None], S.linkify, ['see <a href="HTTP://a.b/c?d=e">a.b/c?d=e</a> now', '<a href="https://twitter.com/bob">@bob</a> and x@y, <a href="https://search.twitter.com/search?q=%23tag">#tag</a>', '<a href="https://t.co/x">t.co/x</a>', 'a\n<a href="https://twitter.com/b">@b</a>', None])
case("node_name", "a string, b string", [("DIV", "div"), ("a", "b"), ("", "")], lambda: S.node_name_is(C("a"), C("b")), "boolean", [True, False, True])
case("placeholder_value", "v string, p string, on boolean", [("Name", "Name", True), ("Name", "Name", False), ("Bob", "Name", True)], lambda: S.placeholder_value(C("v"), C("p"), C("on")), "varchar", ["", "Name", "Bob"])

case("placeholder_set", "v string, p string", [("", "Name"), ("Bob", "Name"), (None, "Name")], lambda: F.concat_ws("/", S.placeholder_set(C("v"), C("p"))["value"], S.placeholder_set(C("v"), C("p"))["flagged"].cast("string")), "varchar", ["Name/true", "Bob/false", "Name/true"])

# Addresses

texts("query_param_cases", ["?a=1&b=2&a=3", "?page&page=3", "?a=x.y<", "", None, "?b=2", "x?a=1?a=2", "?a=", "?a=1=2"], lambda s: S.query_param(s, "a"), ["1", "", "x.y%3C", "", "", "", "1", "", "1=2"])
texts("query_param_blank_name", ["?page&page=3", "?=x&y=1", "?y=1"], lambda s: S.query_param(s, ""), ["page", "x", ""])
texts("query_param_without_equals", ["?page&page=3", "?page", "?page=1&page"], lambda s: S.query_param(s, "page"), ["3", "", "1"])
case("query_param_hash", "s string, h string", [("", "#x?q=7"), ("?q=1", "#q=2"), ("", "#q=5&r=6"), (None, None)], lambda: S.query_param(C("s"), "q", C("h")), "varchar", ["7", "1", "", ""])
texts("encode_if_needed", ["a b", "a<b", 'q"', "a.b", "a;b c", "\\"], S.url_encode_if_needed, ["a b", "a%3Cb", "q%22", "a.b", "a%3Bb%20c", "%5C"])
texts("query_pairs", ["?a=1&b=&a=3&c", "x=%20", ""], lambda s: F.array_join(F.transform(S.query_pairs(s), lambda p: F.concat(p["k"], L(":"), p["v"])), " "), ["a:1 b: a:3 c:", "x:%20", ""])
case("same_origin", "a string, b string", [("http://a/x", "http://a:80/y"), ("http://a", "https://a"), ("https://h:443", "https://H/"), ("http://a:8080", "http://a")], lambda: S.same_origin(C("a"), C("b")), "boolean", [True, False, True, False])
case("flash_vars", "k array<string>", [(["a", "b"],), ([],)], lambda: S.flash_vars(F.map_from_arrays("k", F.transform("k", lambda x: F.concat(x, L(" 1"))))), "varchar", ["a=a 1&b=b 1", ""])
case("param_lists", "m map<string, array<string>>", [({"k": ["a b", None]},), ({"x[]": ["1"]},), ({},)], lambda: S.param_lists(C("m")), "varchar", ["k%5B%5D=a+b&k%5B%5D=", "x%5B%5D=1", ""])
case("param_traditional", "m map<string, array<string>>", [({"k": ["a", "b"]},)], lambda: S.param_lists(C("m"), True), "varchar", ["k=a&k=b"])
case("param_nested", "m map<string, map<string, string>>", [({"k": {"s": "a&b"}},), ({"o": {}},)], lambda: S.param_nested(C("m")), "varchar", ["k%5Bs%5D=a%26b", ""])
case("expand_urls", "t string, u array<struct<url:string,expanded_url:string,display_url:string>>", [
    ("http://t.co/a", [("http://t.co/a", "http://long/x", "long/x")]), ("http://t.co/a", [("http://t.co/a", None, None)]), ("http://t.co/a http://t.co/b", [("http://t.co/a", None, "n"), ("http://t.co/b", "http://b", "b.com")]), ("none", []),
], lambda: S.expand_urls(S.linkify(C("t")), C("u")), "varchar", [
    '<a href="http://long/x">long/x</a>', '<a href="http://t.co/a">t.co/a</a>', '<a href="http://t.co/a">t.co/a</a> <a href="http://b">b.com</a>', "none",
])

# Times and numbers

texts("parse_date", ["Mon Sep 24 03:35:21 +0000 2012", "2014-03-02T10:00:00+02:00", "no date", None], lambda s: F.date_format(S.parse_date(s), "yyyy-MM-dd HH:mm:ss"), ["2012-09-24 03:35:21", "2014-03-02 08:00:00", None, None])
case("pretty_date_edges", "age long", [(-61,), (-60,), (-30,), (0,), (59,), (60,), (3599,), (86400,), (172800,), (604800,), (691200,), (1296000,), (None,)], lambda: S.pretty_date(F.timestamp_seconds(2_000_000_000 - C("age")), F.timestamp_seconds(L(2_000_000_000))), "varchar", ["<span>&infin;</span>", " now", " now", "1m", "1m", "2m", "1h", "1d", "2d", "1w", "2w", "3w", "<span>&infin;</span>"])
texts("is_numeric", ["12", "-1.5e3", "12px", "0x10", "NaN", "", None, ".5", "Infinity"], S.is_numeric, [True, True, False, True, False, False, False, True, False], "boolean")
texts("parse_int", ["12px", "  -7", "x", "3.9", "", None], S.parse_int, [12, -7, None, 3, None, None], "bigint")
texts("extract_version", ["Shockwave Flash 11.2 r202", "Shockwave Flash 10.0", "x"], S.extract_version, ["11.2.202", "10.0.0", "0.0.0"])
case("swing", "p double", [(0.0,), (0.5,), (1.0,)], lambda: F.round(S.swing(C("p")), 6), "double", [0.0, 0.5, 1.0])

# Lists, tags, maps

case("make_array", "s string", [("a",), (None,)], lambda: F.size(S.make_array(C("s"))), "int", [1, 0])
case("map_flat", "a array<int>", [([1, None, 2],), ([],)], lambda: F.array_join(S.map_flat(C("a"), lambda x: F.when(x.isNotNull(), F.array(x, x * 10))).cast("array<string>"), ","), "varchar", ["1,10,2,20", ""])
case("map_values", "a array<int>", [([1, 5, 2],)], lambda: F.array_join(S.map_values(C("a"), lambda x: F.when(x < 4, x * 2)).cast("array<string>"), ","), "varchar", ["2,4"])
case("each_until", "a array<int>", [([1, 5, 2],), ([1, 2],), ([],)], lambda: F.array_join(S.each_until(C("a"), lambda x: x < 3).cast("array<string>"), ","), "varchar", ["1,5", "1,2", ""])
case("grep_list", "a array<int>", [([1, 5, None],), ([],)], lambda: F.array_join(S.grep(C("a"), lambda x: x > 3).cast("array<string>"), ","), "varchar", ["5", ""])
case("grep_list_invert", "a array<int>", [([1, 5],), ([7],)], lambda: F.array_join(S.grep(C("a"), lambda x: x > 3, invert=True).cast("array<string>"), ","), "varchar", ["1", ""])
case("unique_list", "a array<string>", [(["b", "a", "b"],), ([],)], lambda: F.array_join(S.unique(C("a")), ","), "varchar", ["b,a", ""])
case("raw_sort", "a array<int>", [([10, 9, 1, 100],), ([-1, 5],)], lambda: F.array_join(S.raw_sort(C("a")).cast("array<string>"), ","), "varchar", ["1,10,100,9", "-1,5"])
case("in_array_from", "a array<int>", [([1, 2, 1],), ([1],), (None,)], lambda: S.in_array(C("a"), L(1), 1), "bigint", [2, -1, -1])
texts("import_tags", ["a,a, ,b", " x ", "", None], S.import_tags, ["a,a,b", "x", "", ""])
texts("remove_tag_cases", ["a,b,a", "a, a", " b ,a", "", "c"], lambda s: S.remove_tag(s, "a"), ["b", "a", "b", "", "c"])
texts("add_tag_cases", ["a|b", "", "b", "a.c"], lambda s: S.add_tag(s, " b ", "|"), ["a|b", "b", "b", "a.c|b"])
case("length_bounds", "s string", [("abc",), ("",), ("ab",)], lambda: S.length_in_bounds(C("s"), 1, 2), "boolean", [False, False, True])
case("class_tokens", "a array<string>, b array<string>", [(["x", "y"], ["y", "z"]), ([], ["q"])], lambda: F.concat_ws("|", F.array_join(S.add_class(C("a"), C("b")), " "), F.array_join(S.remove_class(C("a"), C("b")), " "), F.array_join(S.toggle_class(C("a"), C("b")), " ")), "varchar", ["x y z|x|x z", "q||q"])
_MAP = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], L("="), e["value"]))), " ")
case("extend", "a map<string,string>, b map<string,string>", [({"x": "1", "y": "2"}, {"y": "3", "z": "4"}), ({"x": "1"}, {"x": None})], lambda: _MAP(S.extend(C("a"), C("b"))), "varchar", ["x=1 y=3 z=4", "x=1"])
case("extend_deep", "a map<string,map<string,string>>, b map<string,map<string,string>>", [({"o": {"p": "1", "q": "2"}}, {"o": {"q": "3"}, "r": {"s": "4"}})], lambda: F.array_join(F.array_sort(F.transform(F.map_entries(S.extend_deep(C("a"), C("b"))), lambda e: F.concat(e["key"], L(":"), _MAP(e["value"])))), ";"), "varchar", ["o:p=1 q=3;r:s=4"])
case("extend_lists", "a array<string>, b array<string>", [(["x", "y", "z"], ["q", None])], lambda: F.array_join(S.extend_lists(C("a"), C("b")), ","), "varchar", ["q,y,z"])
case("options_merge", "a map<string,string>, b map<string,string>, c map<string,string>", [({"x": "1", "y": "1"}, {"y": "2"}, {"x": "3"})], lambda: _MAP(S.options(C("a"), C("b"), C("c"))), "varchar", ["x=3 y=2"])
case("is_empty", "m map<string,string>", [({},), ({"a": "b"},), (None,)], lambda: S.is_empty(C("m")), "boolean", [True, False, True])
texts("type_of", ["1", "1.5", '"s"', "true", "null", "[1]", '{"a":1}'], lambda s: S.type_of(F.try_parse_json(s)), ["number", "number", "string", "boolean", "null", "array", "object"])
texts("is_plain_object", ['{"a":1}', "[1]", "null"], lambda s: S.is_plain_object(F.try_parse_json(s)), [True, False, False], "boolean")
texts("data_coercion", ["true", "1.5", "1.0", "007", '{"a":[1]}', "{bad}", "x", "1e3", "null"], lambda s: F.to_json(S.coerce_data(s)), ["true", "1.5", '"1.0"', '"007"', '{"a":[1]}', '"{bad}"', '"x"', '"1e3"', "null"])
case("data_attributes", "m map<string,string>", [({"data-foo-bar": "1", "id": "x"},)], lambda: _MAP(S.data_attributes(C("m"))), "varchar", ["fooBar=1"])
case("copy_attributes", "m map<string,string>", [({"id": "x", "jQuery17": "5", "jquery": "y"},)], lambda: _MAP(S.copy_attributes(C("m"))), "varchar", ["id=x jquery=y"])
texts("sort_namespaces", ["b.a", "x", "c.b.a"], R.sort_namespaces, ["a.b", "x", "a.b.c"])

# Sources

texts("strip_callback", ['cb({"a":1});', '{"a":1}', "x.y([1])", 'cb ( "q" ) '], feeds.strip_callback, ['{"a":1}', '{"a":1}', "[1]", ' "q" '])
texts("json_value", ['{"k": 3}', 'cb({"k":4})', "{bad"], lambda s: F.try_variant_get(feeds.parse_json(s, strict=False), "$.k", "bigint"), [3, 4, None], "bigint")
texts("xml_value", ["<e><t>a</t></e>", "<e><t>b &amp; c</t><x/></e>"], lambda s: feeds.parse_xml(s, "t string")["t"], ["a", "b & c"])
texts("format_of", ["application/json; x", "text/xml", "application/atom+xml", "text/html", "text/javascript", "image/png", None], lambda s: feeds.parse_by_type(s, s), ["json", "xml", "xml", "html", "script", "text", "text"])


@query("json_parse", "SELECT event_id, (props::json ->> 'k')::bigint AS k FROM events")
def json_parse(spark, d):
    return table(spark, d, "events").select("event_id", feeds.parse_json(C("props"), "k bigint")["k"].alias("k"))


@query("json_wrapped", "SELECT event_id, (props::json ->> 'k')::bigint AS k FROM events")
def json_wrapped(spark, d):
    wrapped = F.concat(L("cb("), "props", L(");"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(feeds.parse_json(wrapped), "$.k", "bigint").alias("k"))


@query("converted", values([("application/json", '{"a":5}', 5), ("text/javascript", "f([1])", None), ("text/html", '{"a":5}', None)], content_type="varchar", body="varchar", a="bigint"))
def converted(spark, d):
    rows = spark.createDataFrame([("application/json", '{"a":5}'), ("text/javascript", "f([1])"), ("text/html", '{"a":5}')], "content_type string, body string")
    return feeds.convert(rows).select("content_type", "body", F.try_variant_get("value", "$.a", "bigint").alias("a"))


@query("json_source", "SELECT e AS event_id, v AS value FROM (VALUES (1::bigint, 'a'), (2::bigint, NULL)) AS t(e, v)")
def json_source(spark, d):
    lines = spark.createDataFrame([('{"event_id":1,"value":"a"}',), ('{"event_id":2}',)], "value string").coalesce(1)
    path = written(lines.select(F.lit(1).alias("x")), "json").inputFiles()[0].rsplit("/", 1)[0] + "-lines"
    lines.write.mode("overwrite").text(path)
    return feeds.get_json(spark, path, "event_id long, value string")


_TWEETS = [("5", "Mon Sep 24 03:35:21 +0000 2012", "hi @bob\nhttp://t.co/a", [("http://t.co/a", "http://long/x", "long")]), ("7", "Mon Sep 24 03:59:40 +0000 2012", "@reply", []), ("6", "x", "plain", None)]


@query("tweets", values([
    ("6", '<li><p><a href="https://twitter.com/me/status/6"><span>&infin;</span></a>plain</p></li>', "<span>&infin;</span>"),
    ("5", '<li><p><a href="https://twitter.com/me/status/5">25m</a>hi <a href="https://twitter.com/bob">@bob</a><br><a href="http://long/x">long</a></p></li>', "25m"),
], id_str="varchar", html="varchar", age="varchar"))
def tweets(spark, d):
    rows = spark.createDataFrame([(a, b, c, (u,)) for a, b, c, u in _TWEETS], "id_str string, created_at string, text string, entities struct<urls:array<struct<url:string,expanded_url:string,display_url:string>>>")
    return feeds.tweets(rows, L("2012-09-24 04:00:00").cast("timestamp"), 2, user="me")


_MARKS = ['{"u":"http://x","d":"a<b","n":"note","t":["p q","r"],"a":"me"}', '{"u":"y","t":""}', '{"u":"z","d":"plain","t":"","a":"me"}']


def _marks(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(_MARKS)], "id int, j string").select("id", F.from_json("j", feeds.BOOKMARK).alias("b")).select("id", "b.*")


@query("bookmarks", values([
    (0, '<li class="pin-item"><p><a class="pin-title" href="http://x">a&lt;b</a><span class="pin-description">note</span>\n <a class="pin-tag" href="https://pinboard.in/u:me/t:p q">p q</a>  <a class="pin-tag" href="https://pinboard.in/u:me/t:r">r</a> </p></li>\n'),
    (1, ""), (2, '<li class="pin-item"><p><a class="pin-title" href="z">plain</a></p></li>\n'),
], id="int", html="varchar"))
def bookmarks(spark, d):
    return feeds.bookmarks(_marks(spark)).select("id", "html")


@query("bookmark_list", values([(0, '<li><a href="http://x" title="Tags: p q, r">a<b</a></li>'), (2, '<li><a href="z" title="Tags: ">plain</a></li>')], id="int", html="varchar"))
def bookmark_list(spark, d):
    return feeds.bookmark_list(_marks(spark).where("d is not null")).select("id", "html")


_REPOS = '{"data":[{"html_url":"u1","name":"a","fork":true,"pushed_at":"2"},{"html_url":"u2","name":"b","fork":false,"pushed_at":"1","description":"x & y"},{"html_url":"u3","name":"c","pushed_at":"3"}]}'


@query("repositories", values([("u3", "c", '<li><a href="u3">c</a><p></p></li>'), ("u2", "b", '<li><a href="u2">b</a><p>x &amp; y</p></li>')], html_url="varchar", name="varchar", html="varchar"))
def repositories(spark, d):
    rows = spark.createDataFrame([(_REPOS,), ("{}",)], "j string").select(F.from_json("j", feeds.REPOS).alias("r")).select("r.*")
    return feeds.repositories(rows, skip_forks=True)


@query("repositories_pushed_last", values([("c",), ("a",)], name="varchar"))
def repositories_pushed_last(spark, d):
    return feeds.repositories(spark.createDataFrame([(_REPOS,)], "j string").select(F.from_json("j", feeds.REPOS).alias("r")).select("r.*"), count=2).select("name")


@query("rendered_list", "SELECT string_agg('<li>' || r_name || '</li>', chr(10) ORDER BY r_regionkey) AS document FROM region")
def rendered_list(spark, d):
    return feeds.document(table(spark, d, "region").select("r_regionkey", F.concat(L("<li>"), "r_name", L("</li>")).alias("line")), "line", "r_regionkey")


@query("skin_parts", values([("", "a", "1"), ("c", "b", "2")], component="varchar", name="varchar", value="varchar"))
def skin_parts(spark, d):
    settings, _ = feeds.skin('<skin><settings><setting name="a" value="1"/></settings><components><component name="c"><settings><setting name="b" value="2"/></settings></component></components></skin>')
    return spark.createDataFrame(settings, "component string, name string, value string")


# Selectors and node sets over an own page

HTML = """<!DOCTYPE html><html lang="en-GB"><body>
<ul id="u1"><li class="a first">one</li><li class="b">two<b>!</b></li></ul>
<ul id="u2"><li href="">three</li><li rel="x-y">four</li></ul>
<p title="x y">text<p>more<br><div id="e"><!-- c --></div><div id="a.b" data-foo-bar="7" data-x="{&quot;k&quot;:1}">dot</div>
<form><input name="t" value="v"><input type="checkbox" name="c" checked><input type="radio" name="r">
<select name="s"><option value="1" selected>A</option><option selected>B</option></select>
<textarea name="ta">l1
l2</textarea><button>go</button><input name="off" disabled><input type="file" name="f"><input type="password" name="pw" value="w"><input type="image" name="i"><input type="submit" name="go" value="s"><input type="reset"></form>
</body></html>"""


def _page(spark):
    return spark.createDataFrame([(1, "http://own/", HTML), (2, "http://none/", None), (3, "http://empty/", "")], "page_id int, url string, html string")


def _label(c: str = "attrs") -> Column:
    """What names an element: its tag, id or name."""
    a = lambda k: F.try_element_at(c, L(k))
    return F.concat("tag", F.coalesce(F.concat(L("#"), a("id")), F.concat(L("."), a("name")), L("")))


def matches(name: str, selector: str, labels: list[str]) -> None:
    @query(name, values(list(enumerate(labels)), pos="bigint", label="varchar"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return N.index(select_pages(_page(spark), selector)).select(C("pos").cast("long").alias("pos"), _label().alias("label"))


matches("select_id", "#u1", ["ul#u1"])
matches("select_class_token", "li.first.a", ["li"])
matches("select_has", "ul:has(b)", ["ul#u1"])
matches("select_contains", "li:contains('two!')", ["li"])
matches("select_contains_none", "ul:contains('TWO'), ul:contains('four')", ["ul#u2"])
matches("select_empty", "div:empty", ["div#e"])
matches("select_parent", "div:parent", ["div#a.b"])
matches("select_root", ":root", ["html"])
matches("select_enabled", "input:enabled", ["input.t", "input.c", "input.r", "input.f", "input.pw", "input.i", "input.go", "input"])
matches("select_disabled", ":disabled", ["input.off"])
matches("select_checked", "input:checked", ["input.c"])
matches("select_selected", ":selected", ["option", "option"])
matches("select_header", ":header, p", ["p", "p"])
matches("select_input", "form :input:not(input)", ["select.s", "textarea.ta", "button"])
matches("select_button", ":button", ["button"])
matches("select_text", ":text", ["input.t", "input.off"])
matches("select_radio", ":radio", ["input.r"])
matches("select_checkbox", ":checkbox", ["input.c"])
matches("select_file", ":file", ["input.f"])
matches("select_password", ":password", ["input.pw"])
matches("select_image", ":image", ["input.i"])
matches("select_submit", ":submit", ["input.go"])
matches("select_reset", ":reset", ["input"])
matches("select_escape", r"#a\.b", ["div#a.b"])
matches("select_only_of_type", "form > select:only-of-type, form > input:only-of-type", ["select.s"])
matches("select_last_of_type", "body > ul:last-of-type", ["ul#u2"])
matches("select_missing_attribute", "ul[id!=u1]", ["ul#u2"])
matches("select_empty_prefix", 'li[href^=""], li[rel]', ["li"])
matches("select_ignoring_case", "UL#u1 > LI:first-child", ["li"])


@query("select_errors", values([(s, True) for s in ("li:hover2", "li >", ", li", "li[", "li:nth-child(x)", "li:focus", "##x")] + [("li, a", False)], selector="varchar", wrong="boolean"))
def select_errors(spark, d):
    def wrong(s: str) -> bool:
        try:
            parse(s)
        except SelectorError:
            return True
        return False

    return spark.createDataFrame([(s, wrong(s)) for s in ("li:hover2", "li >", ", li", "li[", "li:nth-child(x)", "li:focus", "##x", "li, a")], "selector string, wrong boolean")


@query("select_own_pseudo", values([("b",), ("p",), ("p",)], tag="varchar"))
def select_own_pseudo(spark, d):
    register("one-letter", lambda _: F.length("tag") == 1)
    return select_pages(_page(spark), ":one-letter").select("tag")


def own_set(name: str, sql: str):
    """A query over a node table of the own page."""

    def keep(f):
        @query(name, sql)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(written(nodes(_page(spark)), "own"))

        return f

    return keep


@own_set("document_order", values([(0, "ul#u1"), (1, "li"), (2, "li"), (3, "b")], pos="bigint", label="varchar"))
def document_order(n):
    return N.index(N.add(select(n, "#u1 *"), select(n, "#u1"))).select(C("pos").cast("long").alias("pos"), _label().alias("label"))


@own_set("set_filter", values([("li", 2)], tag="varchar", n="bigint"))
def set_filter(n):
    return N.filter_(n, select(n, "li"), "#u1 > li").groupBy("tag").agg(F.count("*").alias("n"))


@own_set("set_not", values([("li", 3)], tag="varchar", n="bigint"))
def set_not(n):
    return N.not_(n, select(n, "li"), ".a").groupBy("tag").agg(F.count("*").alias("n"))


@own_set("set_has", values([("ul#u1",)], label="varchar"))
def set_has(n):
    return N.has(n, select(n, "ul"), "b").select(_label().alias("label"))


@own_set("set_is", values([(1, True, False)], page_id="int", a="boolean", z="boolean"))
def set_is(n):
    li = select(n, "li")
    return N.is_(n, li, ".a").withColumnRenamed("is", "a").join(N.is_(n, li, ".z").withColumnRenamed("is", "z"), "page_id")


@own_set("set_closest", values([("b", "li"), ("option", "form"), ("option", "form")], a="varchar", b="varchar"))
def set_closest(n):
    up = N.closest(n, select(n, "b, option"), "li, form").select("page_id", C("node_id").alias("i"), "closest_id")
    tag = n.select("page_id", "node_id", "tag")
    return up.join(tag.select("page_id", C("node_id").alias("i"), C("tag").alias("a")), ["page_id", "i"]).join(tag.select("page_id", C("node_id").alias("closest_id"), C("tag").alias("b")), ["page_id", "closest_id"]).select("a", "b")


def walked(name: str, start: str, step: str, labels: list[str]) -> None:
    @own_set(name, values(list(enumerate(labels)), walk="bigint", label="varchar"))
    def run(n):
        return N.in_walk_order(N.traverse(n, select(n, start), step), step).select(C("walk").cast("long").alias("walk"), _label().alias("label"))


walked("walk_parent", "b", "parent", ["li"])
walked("walk_parents", "b", "parents", ["li", "ul#u1", "body", "html"])
walked("walk_children", "#u2", "children", ["li", "li"])
walked("walk_next", "#u1", "next", ["ul#u2"])
walked("walk_prev", "select", "prev", ["input.r"])
walked("walk_next_all", "#u1", "next_all", ["ul#u2", "p", "p", "div#e", "div#a.b", "form"])
walked("walk_prev_all", "select", "prev_all", ["input.r", "input.c", "input.t"])
walked("walk_siblings", "#u2", "siblings", ["ul#u1", "p", "p", "div#e", "div#a.b", "form"])


@own_set("walk_contents", values([(3, 1), (1, 1)], kind="int", n="bigint"))
def walk_contents(n):
    return N.traverse(n, select(n, "li.b"), "contents").groupBy(C("kind").cast("int").alias("kind")).agg(F.count("*").alias("n"))


@own_set("walk_until", values([("a", "li"), ("a", "ul#u1"), ("b", "p"), ("b", "p"), ("b", "ul#u2"), ("c", "input.c"), ("c", "input.r")], step="varchar", label="varchar"))
def walk_until(n):
    a = N.traverse_until(n, select(n, "b"), "parents", "body").withColumn("step", L("a"))
    b = N.traverse_until(n, select(n, "#u1"), "next_all", "#e").withColumn("step", L("b"))
    c = N.traverse_until(n, select(n, "select"), "prev_all", "[name=t]").withColumn("step", L("c"))
    return a.unionByName(b).unionByName(c).select("step", _label().alias("label"))


@own_set("set_slice", values([("li", "three"), ("li", "four")], tag="varchar", text="varchar"))
def set_slice(n):
    last = N.slice_(select(n, "li"), -2)
    inner = n.where("kind = 3").select("page_id", C("parent_id").alias("node_id"), C("text").alias("t"))
    return last.join(inner, ["page_id", "node_id"]).select("tag", C("t").alias("text"))


@own_set("set_add_back", values([("ul#u1",), ("li",), ("li",)], label="varchar"))
def set_add_back(n):
    ul = select(n, "ul")
    return N.add_back(n, N.find(n, N.first(ul), "li"), ul, "#u1").select(_label().alias("label"))


@own_set("set_merge", values([("ul#u1", 2), ("ul#u2", 2)], label="varchar", n="bigint"))
def set_merge(n):
    return N.merge(select(n, "ul"), select(n, "ul")).groupBy(_label().alias("label")).agg(F.count("*").alias("n"))


@own_set("set_index_of", values([(1, 2, -1, 1)], page_id="int", a="int", b="int", c="int"))
def set_index_of(n):
    li = select(n, "li")
    a, b = N.index_of(li, select(n, "#u2 > li")), N.index_of(li, select(n, "b"))
    return a.withColumnRenamed("pos", "a").join(b.withColumnRenamed("pos", "b"), "page_id").join(N.sibling_index(select(n, "li.b")).withColumnRenamed("pos", "c"), "page_id")


@own_set("set_contains", values([(1, True, False)], page_id="int", a="boolean", b="boolean"))
def set_contains(n):
    ul = select(n, "#u1")
    return N.contains(ul, select(n, "b")).withColumnRenamed("contains", "a").join(N.contains(ul, select(n, "p")).withColumnRenamed("contains", "b"), "page_id")


@own_set("form_fields", values([("t", "v"), ("c", "on"), ("s", "1"), ("s", "B"), ("ta", "l1\r\nl2"), ("pw", "w")], name="varchar", value="varchar"))
def form_fields(n):
    return N.form_fields(n, select(n, "form")).select("name", "value")


@query("first_value", values([("[name=t]", "v"), ("[name=c]", "on"), ("textarea", "l1\nl2"), ("option", "1"), ("option:last", "B"), ("button", ""), ("[name=r]", "on")], selector="varchar", value="varchar"))
def first_value(spark, d):
    every = ("[name=t]", "[name=c]", "textarea", "option", "option:last", "button", "[name=r]")
    out = None
    for s in every:
        one = N.val(select_pages(_page(spark), s)).select(L(s).alias("selector"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("first_data", values([(1, 7, 1)], page_id="int", a="bigint", b="bigint"))
def first_data(spark, d):
    own = select_pages(_page(spark), "[data-x]")
    a = N.data(own, "fooBar").select("page_id", F.try_variant_get("value", "$", "bigint").alias("a"))
    return a.join(N.data(own, "x").select("page_id", F.try_variant_get("value", "$.k", "bigint").alias("b")), "page_id")


@query("has_class", values([(1, True, False)], page_id="int", a="boolean", b="boolean"))
def has_class(spark, d):
    li = select_pages(_page(spark), "li")
    return N.has_class(li, "first").withColumnRenamed("has", "a").join(N.has_class(li, "fir").withColumnRenamed("has", "b"), "page_id")


@query("load_part", values([("one",), ("two!",)], text_all="varchar"))
def load_part(spark, d):
    return load(_page(spark), "http://own/ #u1 > li").select("text_all")


@query("parse_without_scripts", values([(False, "p"), (True, "p"), (True, "script")], kept="boolean", tag="varchar"))
def parse_without_scripts(spark, d):
    page = "<p>a<script>1</script>b</p>"
    return spark.createDataFrame([(kept, r["tag"]) for kept in (False, True) for r in parse_html(page, kept) if r["tag"]], "kept boolean, tag string")


# Selectors over the driver's pages

_TAGS = r"len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) - len(regexp_extract_all(html, '<script>'))"


@query("universal_count", f"SELECT page_id, ({_TAGS})::bigint AS n FROM pages")
def universal_count(spark, d):
    return N.count(found(spark, d, "*"))


@query("void_elements", "SELECT page_id, (len(regexp_extract_all(html, '<br>')) + len(regexp_extract_all(html, '<meta ')))::bigint AS n FROM pages")
def void_elements(spark, d):
    return N.count(found(spark, d, "br:empty, meta:empty"))


@query("root_language", "SELECT page_id, regexp_extract(html, '<html lang=.([a-z]*)', 1) AS lang FROM pages")
def root_language(spark, d):
    return N.attr(found(spark, d, ":root"), "lang").withColumnRenamed("value", "lang")


@query("of_type", r"""SELECT page_id, l[2] AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) >= 2""")
def of_type(spark, d):
    return found(spark, d, "nav li:nth-of-type(2) > a").select("page_id", F.try_element_at("attrs", L("href")).alias("href"))


@query("nested_tests", r"""SELECT page_id, l[i] AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS l FROM pages), unnest(range(2, len(l))) AS t(i)""")
def nested_tests(spark, d):
    return found(spark, d, "nav li:not(:first-child):not(:last-child) a").select("page_id", F.try_element_at("attrs", L("href")).alias("href"))


@query("node_text_count", r"SELECT page_id, len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '>[^<]+<'))::bigint AS n FROM pages WHERE contains(html, '<nav>')")
def node_text_count(spark, d):
    n = page_nodes(spark, d)
    return N.count(N.traverse(n, select(n, "nav a"), "contents").where("kind = 3"))


# Events

_EVENTS = [(1, "click.b.a"), (2, "click"), (3, "view.a"), (4, "key")]


def _events(spark):
    return E.normalize(spark.createDataFrame(_EVENTS, "event_id int, event_type string"))


@query("event_normalize", values([(1, "click", "a,b"), (2, "click", ""), (3, "view", "a"), (4, "key", "")], event_id="int", type="varchar", ns="varchar"))
def event_normalize(spark, d):
    return _events(spark).select("event_id", "type", F.array_join("namespaces", ",").alias("ns"))


case("toggle_fold", "e array<struct<at:long,show:boolean>>", [([(0, True), (5, False)],), ([(0, True), (12, False)],), ([(12, False), (0, True), (30, True)],), ([(0, True), (3, False), (11, False), (13, True)],), ([],)], lambda: E.toggle_fold(C("e"), 10), "boolean", [True, False, True, False, False])


@query("event_namespaces", values([(1,), (3,)], event_id="int"))
def event_namespaces(spark, d):
    return E.subscribe(_events(spark), "click.a view").select("event_id")


@query("event_unsubscribe", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def event_unsubscribe(spark, d):
    return E.unsubscribe(E.normalize(table(spark, d, "events")), "click view").select("event_id")


_HANDLERS = [(1, "click", [], None), (2, "click", ["menu"], "li"), (3, "view", ["menu", "x"], None), (4, "click", [], "li")]


@query("event_off", values([("click.menu", 1), ("click.menu", 3), ("click.menu", 4), (".menu", 1), (".menu", 4), ("**", 1), ("**", 3), ("4", 1), ("4", 2), ("4", 3)], off="varchar", handler_id="int"))
def event_off(spark, d):
    h = spark.createDataFrame(_HANDLERS, "handler_id int, type string, namespaces array<string>, selector string")
    left = [("click.menu", E.off(h, "click.menu")), (".menu", E.off(h, ".menu")), ("**", E.off(h, selector="**")), ("4", E.off(h, "click", handler_id=4))]
    return left[0][1].withColumn("off", L("click.menu")).unionByName(left[1][1].withColumn("off", L(".menu"))).unionByName(left[2][1].withColumn("off", L("**"))).unionByName(left[3][1].withColumn("off", L("4"))).select("off", "handler_id")


@own_set("event_bubble", values([(0, "b"), (1, "li"), (2, "ul#u1"), (3, "body"), (4, "html")], hop="bigint", label="varchar"))
def event_bubble(n):
    target = select(n, "b").select(L(1).alias("event_id"), "page_id", C("node_id").alias("target_id"))
    hops = E.bubble(target, n)
    return hops.join(n.select("node_id", "tag", "attrs"), "node_id").select(C("hop").cast("long").alias("hop"), _label().alias("label"))


@query("event_fields", values([(1, 65, 15, 7), (2, 3, 9, 9), (3, 0, None, None), (4, 13, None, None)], event_id="int", which="int", page_x="int", page_y="int"))
def event_fields(spark, d):
    rows = [(1, None, 65, 64, None, None, None, 10, 7, 5, None), (2, None, None, None, 2, 9, 9, 1, 1, 1, 1), (3, None, None, None, 0, None, None, None, None, None, None), (4, None, None, 13, None, None, None, None, None, None, None)]
    names = ["event_id", "which", "char_code", "key_code", "button", "page_x", "page_y", "client_x", "client_y", "scroll_x", "scroll_y"]
    return E.input_fields(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))).select("event_id", "which", "page_x", "page_y")


@query("event_dispatch_namespaces", values([(1, 1), (2, 2), (3, 3)], handler_id="int", seq="int"))
def event_dispatch_namespaces(spark, d):
    n = written(nodes(_page(spark)), "own")
    target = select(n, "b").select(L(1).alias("event_id"), "page_id", C("node_id").alias("target_id"), L("click").alias("type"), F.array(L("m")).alias("namespaces"))
    ul = select(n, "#u1").select("node_id").first()["node_id"]
    rows = [(1, "click", ["m", "z"], None, "li", False), (2, "click", ["m"], None, "ul", False), (3, "click", ["m"], ul, None, True), (4, "click", ["z"], None, "li", False), (5, "click", ["m"], None, "body", False), (6, "view", ["m"], None, "li", False)]
    handlers = spark.createDataFrame(rows, "handler_id int, type string, namespaces array<string>, node_id int, selector string, stops boolean")
    matched = select_pages(_page(spark), {s: s for s in ("li", "ul", "body")}).select("page_id", "node_id", F.explode("matched").alias("selector"))
    return E.dispatch(target, handlers, n, matched).select("handler_id", "seq")
