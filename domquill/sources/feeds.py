"""Feeds: JSON and wrapped JSON, XML, robots lines; and the three list pipelines over them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

TWEET = "struct<id_str:string,created_at:string,text:string,entities:struct<urls:array<struct<url:string,expanded_url:string,display_url:string>>>>"
BOOKMARK = "struct<u:string,d:string,n:string,t:variant,a:string>"
REPOS = "struct<data:array<struct<html_url:string,name:string,description:string,fork:boolean,pushed_at:string>>>"


def strip_callback(s: Column) -> Column:
    """The argument of callback(...), or the text itself."""
    inner = F.regexp_extract(s, r"(?s)^\s*[\w$.\[\]]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.when(inner != "", inner).otherwise(s)


def parse_json(s: Column, schema: str | None = None, strict: bool = True) -> Column:
    """Bad JSON raises if strict, else is null; wrapped JSON is unwrapped."""
    bare = strip_callback(s)
    if schema is not None:
        return F.from_json(bare, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return F.parse_json(bare) if strict else F.try_parse_json(bare)


def parse_by_type(content_type: Column, body: Column) -> Column:
    """What a response is by its content type: json, xml, html, script or text."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.rlike("json"), "json").when(t.rlike(r"\bxml"), "xml").when(t.rlike("html"), "html").when(t.rlike("javascript|ecmascript"), "script").otherwise("text")


def parse_xml(s: Column, schema: str, strict: bool = True) -> Column:
    """XML text to a struct; text that isn't XML raises if strict, else is null."""
    return F.from_xml(s, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


#: Converters of a response's body by kind; ``register_converter`` adds more.
CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "json": lambda body: F.try_parse_json(strip_callback(body)),
    "script": lambda body: F.try_parse_json(strip_callback(body)),
}


def register_converter(kind: str, convert: Callable[[Column], Column]) -> None:
    CONVERTERS[kind] = convert


def convert(responses: DataFrame, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """``responses`` with ``kind`` and ``value``, the body as VARIANT by its kind's converter; kinds
    without one, and bodies that can't be converted, have a null value."""
    out = responses.withColumn("kind", parse_by_type(F.col(content_type), F.col(body)))
    value = F.lit(None).cast("variant")
    for kind, f in CONVERTERS.items():
        value = F.when(F.col("kind") == kind, f(F.col(body))).otherwise(value)
    return out.withColumn("value", value)


def get(spark: SparkSession, path: str, kind: str = "text", schema: str | None = None) -> DataFrame:
    """A source by its kind: "text" (value: lines), "json" (rows of ``schema``, or as found), or "xml"
    with the row tag as ``schema``."""
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    return read_xml(spark, path, schema or "row") if kind == "xml" else spark.read.text(path)


def get_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return get(spark, path, "json", schema)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "entry")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "url")


def skin(xml: str) -> tuple[list[tuple], list[tuple]]:
    """A player skin's settings (component, name, value) and elements (component, name, src)."""
    root = ET.fromstring(xml)
    settings = [("", s.get("name"), s.get("value")) for s in root.findall("./settings/setting")]
    elements = []
    for c in root.iter("component"):
        settings += [(c.get("name"), s.get("name"), s.get("value")) for s in c.findall("./settings/setting")]
        elements += [(c.get("name"), e.get("name"), e.get("src")) for e in c.findall("./elements/element")]
    return settings, elements


def robots(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): a row for each line that isn't blank or a comment; values may be empty."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = F.split("value", ":", 2)
    return lines.select(F.trim(F.get(part, F.lit(0))).alias("key"), F.trim(F.coalesce(F.get(part, F.lit(1)), F.lit(""))).alias("value"))


def limited(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in order; none or 0 is no limit."""
    ordered = df.orderBy(*order) if order else df
    return ordered.limit(n) if n else ordered


def tweets(rows: DataFrame, now: Column, count: int | None = None, replies: bool = False, user: str = "") -> DataFrame:
    """(id_str, html, age): shown texts of the newest ``count`` rows; replies left out if asked."""
    kept = rows if replies else rows.where(~F.coalesce(F.col("text").startswith("@"), F.lit(False)))
    kept = limited(kept, count, F.col("id_str").cast("decimal(20,0)").desc_nulls_last())
    urls = F.coalesce(F.col("entities.urls"), F.array().cast("array<struct<url:string,expanded_url:string,display_url:string>>"))
    body = S.expand_urls(S.linkify(S.newline_to_br(F.col("text"))), urls)
    age = S.pretty_date(S.parse_date(F.col("created_at")), now)
    link = F.concat(F.lit(f'<a href="https://twitter.com/{user}/status/'), F.col("id_str"), F.lit('">'), age, F.lit("</a>"))
    return kept.select("id_str", F.concat(F.lit("<li><p>"), link, body, F.lit("</p></li>")).alias("html"), age.alias("age"))


def bookmark_tags(t: Column) -> Column:
    """A list of tags; "" instead of a list is an empty one."""
    return F.coalesce(F.try_variant_get(t, "$", "array<string>"), F.array().cast("array<string>"))


def bookmarks(rows: DataFrame, cook=S.html_escape) -> DataFrame:
    """``rows`` with ``html``; an entry without a title keeps an empty line. ``cook`` makes a text
    safe (``S.cook_quirk`` as it was shipped)."""
    # The markup and addresses below are what such lists consist of.
    text = lambda c: cook(F.coalesce(c, F.lit("")))
    owner = F.concat(F.lit(' <a class="pin-tag" href="https://pinboard.in/u:'), text(F.col("a")), F.lit("/t:"))
    links = F.array_join(F.transform(bookmark_tags(F.col("t")), lambda x: F.concat(owner, text(x), F.lit('">'), S.tag_trim(text(x)), F.lit("</a> "))), "")
    title = F.concat(F.lit('<p><a class="pin-title" href="'), text(F.col("u")), F.lit('">'), text(F.col("d")), F.lit("</a>"))
    note = F.when(F.coalesce("n", F.lit("")) != "", F.concat(F.lit('<span class="pin-description">'), text(F.col("n")), F.lit("</span>\n"))).otherwise("")
    line = F.concat(F.lit('<li class="pin-item">'), title, note, links, F.lit("</p></li>\n"))
    return rows.withColumn("html", F.when(F.coalesce("d", F.lit("")) == "", "").otherwise(line))


def bookmark_list(rows: DataFrame) -> DataFrame:
    """``rows`` with ``html``, the plain list's line: an address, its tags as a title, its name."""
    tags = F.array_join(bookmark_tags(F.col("t")), ", ")
    return rows.withColumn("html", F.concat(F.lit('<li><a href="'), F.col("u"), F.lit('" title="Tags: '), tags, F.lit('">'), F.col("d"), F.lit("</a></li>")))


def repositories(envelopes: DataFrame, skip_forks: bool = False, count: int | None = None) -> DataFrame:
    """(html_url, name, html) of an envelope's repositories, those pushed last first."""
    rows = envelopes.select(F.inline("data"))
    if skip_forks:
        rows = rows.where(~F.coalesce("fork", F.lit(False)))
    rows = limited(rows, count, F.col("pushed_at").desc_nulls_last(), "name")
    return rows.select("html_url", "name", F.concat(F.lit('<li><a href="'), F.col("html_url"), F.lit('">'), F.col("name"), F.lit("</a><p>"), S.html_escape(F.coalesce("description", F.lit(""))), F.lit("</p></li>")).alias("html"))


def document(lines: DataFrame, column: str, *order: str, sep: str = "\n") -> DataFrame:
    """One text of all lines in order: for the end of a pipeline that was limited, as its lines
    meet in one place."""
    rows = F.array_sort(F.collect_list(F.struct(*order, column)))
    return lines.agg(F.array_join(F.transform(rows, lambda r: r[column]), sep).alias("document"))
