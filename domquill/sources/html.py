"""Pages to node tables: one row a node, numbered in document order, with intervals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import select, texts
from ..plans.match import Page, matchable
from ..plans.selector import parse
from ..session import reach_package, written

NODE_FIELDS = (
    "node_id int, last int, parent_id int, depth int, kind tinyint, tag string, attrs map<string,string>, classes array<string>, "
    "text string, elem_idx int, elem_idx_rev int, type_idx int, type_idx_rev int, n_content_children int"
)
ELEMENT, TEXT, COMMENT, DOCTYPE = 1, 3, 8, 10
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that stands open is closed by the start of one of these.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Elements beyond which a start tag closes nothing.
SCOPE = frozenset("ul ol dl select table div body html article section nav".split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def _add(self, kind: int, tag: str | None = None, attrs: dict | None = None, text: str | None = None) -> dict:
        up = self.open[-1] if self.open else None
        row = {"node_id": len(self.rows), "last": len(self.rows), "parent_id": up and up["node_id"], "depth": len(self.open), "kind": kind, "tag": tag, "attrs": attrs or {}, "text": text}
        self.rows.append(row)
        return row

    def _shut(self, at: int) -> None:
        for row in self.open[at:]:
            row["last"] = len(self.rows) - 1
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        at = len(self.open)
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k]["tag"]
            if tag in CLOSED_BY.get(name, ()):
                at = k
            if name in SCOPE and name not in CLOSED_BY:
                break
        self._shut(at)
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept.setdefault(k, v or "")
        row = self._add(ELEMENT, tag, kept)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1]["tag"] == tag:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                self._shut(k)
                return

    def handle_data(self, data):
        self._add(TEXT, text=data)

    def handle_comment(self, data):
        self._add(COMMENT, text=data)

    def handle_decl(self, decl):
        self._add(DOCTYPE, text=decl)

    def done(self) -> list[dict]:
        self.close()
        self._shut(0)
        kids: dict[int | None, list[dict]] = {}
        for r in self.rows:
            r["classes"] = re.split(r"[ \t\r\n\f]+", r["attrs"].get("class", "").strip(" \t\r\n\f")) if r["attrs"].get("class", "").strip() else []
            kids.setdefault(r["parent_id"], []).append(r)
        for r in self.rows:
            r["n_content_children"] = sum(k["kind"] in (ELEMENT, TEXT) for k in kids.get(r["node_id"], ()))
        for own in kids.values():
            elements = [k for k in own if k["kind"] == ELEMENT]
            total: dict[str, int] = {}
            for i, k in enumerate(elements, 1):
                total[k["tag"]] = total.get(k["tag"], 0) + 1
                k |= {"elem_idx": i, "elem_idx_rev": len(elements) - i + 1, "type_idx": total[k["tag"]]}
            for k in elements:
                k["type_idx_rev"] = total[k["tag"]] - k["type_idx"] + 1
        return self.rows


def parse_html(html: str | None, keep_scripts: bool = False, references: bool = True) -> list[dict]:
    """The nodes of a page, in document order; without ``keep_scripts`` no script elements. Without
    ``references`` texts and attributes stay as the page has them, ``&amp;`` and all."""
    html, tree = html or "", _Tree()
    # A character that the page hasn't stands for "&" while it is parsed: nothing begins a reference.
    mark = None if references or "&" not in html else next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
    tree.feed(html.replace("&", mark) if mark else html)
    tree.close()
    tree._shut(0)
    for r in tree.rows if mark else ():
        r["tag"], r["text"] = (x and x.replace(mark, "&") for x in (r["tag"], r["text"]))
        r["attrs"] = {k.replace(mark, "&"): v.replace(mark, "&") for k, v in r["attrs"].items()}
    if keep_scripts:
        return tree.done()
    new: list[int] = []  # each node's number once scripts are gone, or that of the last one before it
    left, stop = [], -1
    for r in tree.rows:
        if r["tag"] == "script":
            stop = max(stop, r["last"])
        if r["node_id"] > stop:
            left.append(r)
        new.append(len(left) - 1)
    for r in left:
        r["node_id"], r["last"], r["parent_id"] = new[r["node_id"]], new[r["last"]], None if r["parent_id"] is None else new[r["parent_id"]]
    tree.rows = left
    return tree.done()


_NAMES = [f.split()[0] for f in re.split(r", (?=\w+ \w)", NODE_FIELDS)]
_KINDS = [pa.int32()] * 4 + [pa.int8(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string()] + [pa.int32()] * 5


def _parsed(pages: DataFrame, key: str, html: str, of_page: Callable[[str | None], Iterable[dict]], more: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """A row for each that ``of_page`` gives of a page, a few pages' at a time."""
    names, kinds = [*_NAMES, *more], [*_KINDS, *more.values()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [(i, r) for i, h in zip(part.column(0).to_pylist(), part.column(1)) for r in of_page(h.as_py())]
                columns = [pa.array([list(r[n].items()) if n == "attrs" and n in r else r.get(n) for _, r in found], t) for n, t in zip(names, kinds)]
                yield pa.record_batch([pa.array([i for i, _ in found], batch.schema.field(0).type), *columns], ["page_id", *names])

    reach_package(pages.sparkSession)
    return pages.select(key, html).mapInArrow(walk, f"page_id {pages.schema[key].dataType.simpleString()}, {NODE_FIELDS}{ddl}")


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", keep_scripts: bool = False, references: bool = True) -> DataFrame:
    """``pages`` as ``page_id`` and NODE_FIELDS, one row a node, without a shuffle; no scripts unless
    asked for.

    ``node_id`` counts in document order and ``last`` is the number of a node's last descendant, so
    descendant-or-self is ``node_id between a.node_id and a.last``. Element positions count from 1.
    Null and empty pages have no nodes. Character references are decoded as HTML does, or left as
    they stand without ``references``. Attribute names are in lower case, the first of a name counts.
    A plan that reads nodes several times parses as often: ``written`` ends that.
    """
    return _parsed(pages, key, html, lambda h: parse_html(h, keep_scripts, references), {}, "")


def select_pages(pages: DataFrame, selectors: str | dict[str, str], key: str = "page_id", html: str = "html", keep_scripts: bool = False, references: bool = True, every: bool = False) -> DataFrame:
    """The elements of ``pages`` that a selector matches, each once: their rows as of ``nodes``, with
    ``matched``, the names of those of ``selectors`` that match ("" for one without a name), and
    ``text_all``, the text within. With ``every``, a page without a match has one row too, that of no
    node: its ``text_all`` is empty, that of a null page null.

    Matched in the pass that parses a page: one read, no join, no shuffle. Selectors are read, and
    wrong ones refused, before any job. One with a pseudo-class of one's own goes by way of a node
    table (``compile.select``), as that is a Column.
    """
    named = {"": selectors} if isinstance(selectors, str) else dict(selectors)
    parsed = {name: parse(s) for name, s in named.items()}
    if not all(map(matchable, named.values())):
        if every:
            raise ValueError("a page without a match has no row where a selector has a pseudo-class of one's own")
        n = written(nodes(pages, key, html, keep_scripts, references), "nodes")
        found = reduce(DataFrame.unionByName, [select(n, s).withColumn("name", F.lit(name)) for name, s in named.items()])
        found = found.groupBy(*n.columns[:3]).agg(F.array_sort(F.collect_set("name")).alias("matched"))
        own = n.join(found, n.columns[:3], "left_semi")
        return own.join(found.select("page_id", "node_id", "matched"), ["page_id", "node_id"]).join(texts(n, own), ["page_id", "node_id"])

    def of_page(text: str | None) -> Iterator[dict]:
        page = Page(parse_html(text, keep_scripts, references))
        by: dict[int, list[str]] = {}
        for name, groups in parsed.items():
            for k in page.select(groups):
                by.setdefault(k, []).append(name)
        for k in sorted(by):
            yield page.rows[k] | {"matched": sorted(by[k]), "text_all": page.text(k)}
        if every and not by:
            yield {"matched": [], "text_all": None if text is None else ""}

    return _parsed(pages, key, html, of_page, {"matched": pa.list_(pa.string()), "text_all": pa.string()}, ", matched array<string>, text_all string")


def load(pages: DataFrame, address: str, url: str = "url", **names: str) -> DataFrame:
    """"url selector": the elements of the page at that url that match, all elements without a
    selector. The url is a pushed filter, so other pages aren't parsed."""
    at, _, selector = address.strip().partition(" ")
    return select_pages(pages.where(F.col(url) == at), selector.strip() or "*", **names)
