import pytest
from pyspark.sql import functions as F

from domquill.functions import scalars as S
from domquill.operators import rows as R
from domquill.sources import feeds
from domquill.streaming import events as E


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize(
    ("age", "label"),
    [(-61, "<span>&infin;</span>"), (-60, " now"), (-30, " now"), (-1, " now"), (0, "1m"), (59, "1m"), (60, "2m"), (3599, "1h"), (86400, "1d"), (2 * 86400, "2d"), (6 * 86400, "6d"), (7 * 86400, "1w"), (8 * 86400, "2w"), (15 * 86400, "3w")],
)
def test_pretty_date(spark, age, label):
    now = F.timestamp_seconds(L(2_000_000_000))
    assert one(spark, S.pretty_date(F.timestamp_seconds(L(2_000_000_000 - age)), now)) == label


def test_text(spark):
    cases = [
        (S.trim(L("﻿  a  ")), "a"), (S.trim(L(None).cast("string")), ""), (S.camel_case(L("-ms-foo-bar")), "msFooBar"), (S.camel_case(L("font-size")), "fontSize"), (S.decamelize(L("fooBar")), "foo-bar"),
        (S.html_escape(L("<a>&")), "&lt;a&gt;&amp;"), (S.cook_quirk(L("<a><b>")), "&lt;a&gt><b>"), (S.not_blank(L("  ")), None), (S.anchor_fragment(L("http://x/y#z")), "#z"), (S.strip_tag_suffix(L("x_tag")), "x"),
        (S.fill_template(L("{{ a }}{{ a }}"), {"a": L("1")}), "1{{ a }}"), (S.query_param(L("?a=1&b=2&a=3"), "a"), "1"), (S.query_param(L(""), "q", L("#x?q=7")), "7"), (S.query_param(L("?a=1"), "b"), ""), (S.query_param(L("?a=x.y"), "a"), "x.y"),
        (S.encode_component(L("a b!'()*~")), "a%20b!'()*~"), (S.is_numeric(L("12px")), False), (S.is_numeric(L("0x10")), True), (S.is_numeric(L("NaN")), False), (S.parse_int(L("12px")), 12), (S.parse_int(L("x")), None),
        (S.version_ge(L("9.0.0"), L("9")), True), (S.extract_version(L("Shockwave Flash 11.2 r202")), "11.2.202"), (S.in_array(F.array(L(1), L(2)), L(2)), 1), (S.in_array(F.array(L(1)), L(5)), -1),
        (S.import_tags(L("a,a, ,b")), "a,a,b"), (S.remove_tag(L("a,b,a"), "a"), "b"), (S.add_tag(L("a|b"), "b", "|"), "a|b"), (S.add_tag(L(""), "x"), "x"), (S.same_origin(L("http://a/x"), L("http://a:80/y")), True),
        (S.same_origin(L("http://a"), L("https://a")), False), (S.length_in_bounds(L("abc"), 1, 2), False), (S.toggle_class(F.array(L("a")), F.array(L("a"), L("b"))), ["b"]), (S.extend(F.create_map(L("a"), L(1)), F.create_map(L("a"), L(2), L("b"), L(3))), {"a": 2, "b": 3}),
        (S.map_flat(F.array(L(1), L(2)), lambda x: F.array(x, x + 10)), [1, 11, 2, 12]), (S.each_until(F.array(L(1), L(5), L(2)), lambda x: x < 3), [1, 5]), (S.grep(F.array(L(1), L(5)), lambda x: x > 3, invert=True), [1]),
        (S.param(F.array(F.struct(L("a b").alias("k"), L(None).cast("string").alias("v")))), "a+b="), (feeds.strip_callback(L("cb({\"a\":1});")), '{"a":1}'),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]


@pytest.mark.parametrize(("text", "json"), [("true", "true"), ("1.5", "1.5"), ("1.0", '"1.0"'), ("007", '"007"'), ('{"a":[1]}', '{"a":[1]}'), ("{bad}", '"{bad}"'), ("x", '"x"')])
def test_data_coercion(spark, text, json):
    assert one(spark, F.to_json(S.coerce_data(L(text)))) == json


def test_pairs_read_back(spark):
    assert [tuple(x) for x in one(spark, S.query_pairs(L("?a=1&b=&a=3&c")))] == [("a", "1"), ("b", ""), ("a", "3"), ("c", "")]


def test_feeds(spark, tmp_path):
    env = spark.sql("select from_json('{\"data\":[{\"html_url\":\"u1\",\"name\":\"a\",\"fork\":true,\"pushed_at\":\"2\"},{\"html_url\":\"u2\",\"name\":\"b\",\"fork\":false,\"pushed_at\":\"1\"},{\"html_url\":\"u3\",\"name\":\"c\"}]}', '" + feeds.REPOS + "') as e").select("e.*")
    assert [r["name"] for r in feeds.repositories(env, skip_forks=True).collect()] == ["b", "c"]
    assert feeds.repositories(env, count=0).count() == 3 and feeds.repositories(env, count=1).first()["name"] == "a"
    marks = spark.sql("select from_json(v, '" + feeds.BOOKMARK + "') b from values ('{\"u\":\"x\",\"d\":\"t\",\"t\":[\"p\"]}'), ('{\"u\":\"y\",\"t\":\"\"}') as t(v)").select("b.*")
    assert [r["html"] for r in feeds.bookmarks(marks).collect()][1] == ""
    tw = spark.sql("select from_json('{\"id_str\":\"5\",\"created_at\":\"Mon Sep 24 03:35:21 +0000 2012\",\"text\":\"hi @bob http://t.co/a\",\"entities\":{\"urls\":[{\"url\":\"http://t.co/a\",\"expanded_url\":\"http://long\",\"display_url\":\"long\"}]}}', '" + feeds.TWEET + "') t").select("t.*")
    row = feeds.tweets(tw, F.lit("2012-09-24 04:00:00").cast("timestamp"), 1).first()
    assert row["age"] == "25m" and 'href="http://long"' in row["html"] and "@bob</a>" in row["html"]
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow:\nSitemap: http://x/s.xml\n")
    assert [tuple(r) for r in feeds.robots(spark, str(tmp_path / "robots.txt")).collect()] == [("User-agent", "*"), ("Disallow", ""), ("Sitemap", "http://x/s.xml")]
    (tmp_path / "s.xml").write_text('<urlset><url><loc>a</loc></url><url><loc>b</loc></url></urlset>')
    assert feeds.sitemap(spark, str(tmp_path / "s.xml")).count() == 2
    assert feeds.skin('<skin><settings><setting name="a" value="1"/></settings><components><component name="c"><elements><element name="e" src="s"/></elements></component></components></skin>') == ([("", "a", "1")], [("c", "e", "s")])


def test_rows_and_events(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("abc")] + [(2, 0, "z")], "k int, i int, v string")
    got = {(r["k"], r["i"]): (r["next"], r["prev"]) for r in R.cycle(df, ["k"], ["i"], "v").collect()}
    assert got == {(1, 0): ("b", "c"), (1, 1): ("c", "a"), (1, 2): ("a", "b"), (2, 0): ("z", "z")}
    assert [r["row_class"] for r in R.row_class(df, ["k"], ["i"]).orderBy("k", "i").collect()] == ["first odd", "even", "odd", ""]
    ev = E.normalize(spark.createDataFrame([(1, "click.b.a"), (2, "click"), (3, "view")], "event_id int, event_type string"))
    assert [r[0] for r in E.subscribe(ev, "click.a view").select("event_id").orderBy("event_id").collect()] == [1, 3]
    assert E.unsubscribe(ev, "click").count() == 1


def test_registered_sql_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_streaming_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "user_id int, ts string").selectExpr("user_id", "cast(ts as timestamp) ts").write.parquet(str(src))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(src))
    q = E.once_stream(stream, ["user_id"], "ts", "1 hour").writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once_out").count() == 2
