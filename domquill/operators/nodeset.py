"""Ordered, distinct sets of nodes: a DataFrame of node rows, with (page_id, node_id) as order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import coerce_data, decamelize
from ..plans.compile import positional, relate, select, texts

KEY = ["page_id", "node_id"]


def find(nodes: DataFrame, of: DataFrame, selector: str) -> DataFrame:
    return select(nodes, selector, of)


def filter_(nodes: DataFrame, of: DataFrame, by: str | Column | DataFrame) -> DataFrame:
    """Rows that match a selector, hold a condition, or are in another set."""
    if isinstance(by, Column):
        return of.where(by)
    return relate(of, select(nodes, by) if isinstance(by, str) else by, "is")


def not_(nodes: DataFrame, of: DataFrame, by: str | Column | DataFrame) -> DataFrame:
    """The complement of ``filter_``: a condition that is null counts as not held."""
    if isinstance(by, Column):
        return of.where(~F.coalesce(by, F.lit(False)))
    return relate(of, select(nodes, by) if isinstance(by, str) else by, "is", "left_anti")


def has(nodes: DataFrame, of: DataFrame, selector: str) -> DataFrame:
    return relate(of, select(nodes, selector), "up")


def is_(nodes: DataFrame, of: DataFrame, selector: str) -> DataFrame:
    """(page_id, is): whether any row of the page's set matches."""
    hit = select(nodes, selector).select(*KEY, F.lit(True).alias("hit"))
    return of.join(hit, KEY, "left").groupBy("page_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("is"))


def closest(nodes: DataFrame, of: DataFrame, selector: str) -> DataFrame:
    """(page_id, node_id, closest_id): the nearest of a node and its ancestors that matches."""
    up = select(nodes, selector).select(F.col("page_id").alias("u_page"), F.col("node_id").alias("u_id"), F.col("last").alias("u_last"))
    on = (F.col("page_id") == F.col("u_page")) & (F.col("u_id") <= F.col("node_id")) & (F.col("u_last") >= F.col("node_id"))
    return of.join(up, on).groupBy(*KEY).agg(F.max("u_id").alias("closest_id"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(KEY)


def add_back(nodes: DataFrame, of: DataFrame, before: DataFrame, selector: str | None = None) -> DataFrame:
    """The set and the one before it, or those of that one that match."""
    return add(of, before if selector is None else filter_(nodes, before, selector))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both, repeats kept."""
    return a.unionByName(b)


def _walk(nodes: DataFrame, of: DataFrame, condition: Column, kinds: Column | None = None) -> DataFrame:
    e = of.select(*[F.col(c).alias(f"e_{c}") for c in ("page_id", "node_id", "last", "parent_id", "elem_idx")])
    rows = nodes.where(F.col("kind") == 1 if kinds is None else kinds)
    return rows.join(e, (F.col("page_id") == F.col("e_page_id")) & condition, "left_semi")



def _sibling() -> Column:
    return F.col("parent_id").eqNullSafe(F.col("e_parent_id"))


_STEPS = {
    "parent": lambda: F.col("node_id") == F.col("e_parent_id"),
    "parents": lambda: (F.col("node_id") < F.col("e_node_id")) & (F.col("last") >= F.col("e_node_id")),
    "children": lambda: F.col("parent_id") == F.col("e_node_id"),
    "next": lambda: _sibling() & (F.col("elem_idx") == F.col("e_elem_idx") + 1),
    "prev": lambda: _sibling() & (F.col("elem_idx") == F.col("e_elem_idx") - 1),
    "next_all": lambda: _sibling() & (F.col("elem_idx") > F.col("e_elem_idx")),
    "prev_all": lambda: _sibling() & (F.col("elem_idx") < F.col("e_elem_idx")),
    "siblings": lambda: _sibling() & (F.col("elem_idx") != F.col("e_elem_idx")),
}


def traverse(nodes: DataFrame, of: DataFrame, step: str, selector: str | None = None) -> DataFrame:
    """parent, parents, children, contents, next, prev, next_all, prev_all or siblings of a set,
    each row once, optionally only those that match. Read parents and prev_all by falling
    (page_id, node_id) where the walk's order matters."""
    if step == "contents":
        out = _walk(nodes, of, F.col("parent_id") == F.col("e_node_id"), F.col("kind").isin(1, 3, 8))
    else:
        out = _walk(nodes, of, _STEPS[step]())
    return out if selector is None else filter_(nodes, out, selector)


def traverse_until(nodes: DataFrame, of: DataFrame, step: str, until: str, selector: str | None = None) -> DataFrame:
    """next_all, prev_all or parents of each row, up to but without the first that matches."""
    stop = select(nodes, until).select("page_id", *[F.col(c).alias(f"s_{c}") for c in ("node_id", "last", "parent_id", "elem_idx")])
    e = of.select("page_id", *[F.col(c).alias(f"e_{c}") for c in ("node_id", "parent_id", "elem_idx")])
    same = F.col("s_parent_id").eqNullSafe(F.col("e_parent_id"))
    reach = {"next_all": same & (F.col("s_elem_idx") > F.col("e_elem_idx")), "prev_all": same & (F.col("s_elem_idx") < F.col("e_elem_idx")), "parents": (F.col("s_node_id") < F.col("e_node_id")) & (F.col("s_last") >= F.col("e_node_id"))}[step]
    bound = F.min("s_node_id") if step == "next_all" else F.max("s_node_id")
    e = e.join(stop.withColumnRenamed("page_id", "s_page"), (F.col("page_id") == F.col("s_page")) & reach, "left").groupBy("page_id", "e_node_id", "e_parent_id", "e_elem_idx").agg(bound.alias("bound"))
    e = e.withColumnRenamed("page_id", "e_page_id")
    inside = F.col("bound").isNull() | ((F.col("node_id") < F.col("bound")) if step == "next_all" else (F.col("node_id") > F.col("bound")))
    out = nodes.where("kind = 1").join(e, (F.col("page_id") == F.col("e_page_id")) & _STEPS[step]() & inside, "left_semi")
    return out if selector is None else filter_(nodes, out, selector)


def eq(of: DataFrame, k: int) -> DataFrame:
    return positional(of, "eq", k)


def first(of: DataFrame) -> DataFrame:
    return positional(of, "first", None)


def last(of: DataFrame) -> DataFrame:
    return positional(of, "last", None)


def slice_(of: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Each page's rows from ``start`` to before ``stop``; negative places count from the end."""
    w = Window.partitionBy("page_id")
    x = of.withColumn("at_", F.row_number().over(w.orderBy("node_id")) - 1).withColumn("total_", F.count("*").over(w))
    place = lambda k: F.lit(k) if k >= 0 else F.greatest(F.col("total_") + k, F.lit(0))
    keep = F.col("at_") >= place(start)
    return x.where(keep if stop is None else keep & (F.col("at_") < place(stop))).drop("at_", "total_")


def index(of: DataFrame) -> DataFrame:
    """The set with ``pos``, each row's place in its page from 0."""
    return of.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1)


def count(of: DataFrame) -> DataFrame:
    return of.groupBy("page_id").agg(F.count("*").alias("n"))


def attr(of: DataFrame, name: str) -> DataFrame:
    """(page_id, value): the attribute of each page's first row."""
    return first(of).select("page_id", F.try_element_at("attrs", F.lit(name)).alias("value"))


def has_class(of: DataFrame, name: str) -> DataFrame:
    """(page_id, has): whether any row of a page's set has the class."""
    return of.groupBy("page_id").agg(F.bool_or(F.array_contains("classes", name)).alias("has"))


#: How a control's value is read, by tag; ``register_value`` adds more. All others have their value
#: attribute, "" without one.
VALUES: dict[str, Callable[[], Column]] = {
    "textarea": lambda: F.col("text_all"),
    "option": lambda: F.coalesce(F.try_element_at("attrs", F.lit("value")), F.col("text_all")),
    "input": lambda: F.coalesce(F.try_element_at("attrs", F.lit("value")), F.when(F.lower(F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("text"))).isin("checkbox", "radio"), "on").otherwise("")),
}


def register_value(tag: str, read: Callable[[], Column]) -> None:
    VALUES[tag] = read


def val(of: DataFrame) -> DataFrame:
    """(page_id, value): the value of each page's first row, without carriage returns; ``of`` has
    ``text_all`` (see ``select_pages``)."""
    value = F.coalesce(F.try_element_at("attrs", F.lit("value")), F.lit(""))
    for tag, read in VALUES.items():
        value = F.when(F.col("tag") == tag, read()).otherwise(value)
    return first(of).select("page_id", F.replace(value, F.lit("\r"), F.lit("")).alias("value"))


def data(of: DataFrame, name: str) -> DataFrame:
    """(page_id, value): the first row's data attribute as VARIANT; the name may be in camel case."""
    raw = F.try_element_at("attrs", F.concat(F.lit("data-"), decamelize(F.lit(name))))
    return first(of).select("page_id", coerce_data(raw).alias("value"))


def index_of(of: DataFrame, target: DataFrame) -> DataFrame:
    """(page_id, pos): the place in each page's set of the target's first row, -1 if it isn't there."""
    want = first(target).select(F.col("page_id").alias("t_page"), F.col("node_id").alias("t_id"))
    own = index(of).select("page_id", "node_id", "pos")
    found = want.join(own, (F.col("page_id") == F.col("t_page")) & (F.col("node_id") == F.col("t_id")), "left")
    return found.select(F.col("t_page").alias("page_id"), F.coalesce("pos", F.lit(-1)).alias("pos"))


def sibling_index(of: DataFrame) -> DataFrame:
    """(page_id, pos): the place of each page's first row among its siblings."""
    return first(of).select("page_id", (F.col("elem_idx") - 1).alias("pos"))


def contains(of: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, contains): whether the first row of a page's set holds the other set's first row."""
    inner = first(other).select("page_id", F.col("node_id").alias("o_id"))
    return first(of).join(inner, "page_id").select("page_id", ((F.col("o_id") > F.col("node_id")) & (F.col("o_id") <= F.col("last"))).alias("contains"))


def in_walk_order(of: DataFrame, step: str) -> DataFrame:
    """The set with ``walk``, each row's place in its page in the order that a step goes: parents and
    previous siblings come nearest first, all others in document order."""
    order = F.desc("node_id") if step in ("parents", "prev", "prev_all") else F.asc("node_id")
    return of.withColumn("walk", F.row_number().over(Window.partitionBy("page_id").orderBy(order)) - 1)


def joined_text(of: DataFrame) -> DataFrame:
    """(page_id, text): the texts of all rows that have ``text_all``, in document order."""
    return of.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text_all"))), lambda x: x["text_all"]), "").alias("text"))


def text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(page_id, text): the texts of all rows, put together in document order."""
    if "text_all" in of.columns:
        return joined_text(of)
    parts = texts(nodes, of)
    return parts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text_all"))), lambda x: x["text_all"]), "").alias("text"))


def form_fields(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(page_id, node_id, name, value) of a form's successful controls: named, enabled, not a
    button, boxes and circles only if checked, a row for each selected option; line ends CRLF."""
    a = lambda n: F.try_element_at("attrs", F.lit(n))
    kind = F.lower(F.coalesce(a("type"), F.lit("text")))
    controls = relate(select(nodes, "input, select, textarea"), of, " ").where(a("name").isNotNull() & (a("name") != "") & a("disabled").isNull())
    controls = controls.where((F.col("tag") != "input") | ~kind.isin("submit", "button", "image", "reset", "file") & (~kind.isin("checkbox", "radio") | a("checked").isNotNull()))
    plain = controls.where("tag = 'input'").select(*KEY, a("name").alias("name"), F.coalesce(a("value"), F.when(kind.isin("checkbox", "radio"), "on").otherwise("")).alias("value"))
    area = controls.where("tag = 'textarea'")
    area = texts(nodes, area).join(area.select(*KEY, a("name").alias("name")), KEY).select(*KEY, "name", F.col("text_all").alias("value"))
    options = select(nodes, "option[selected]")
    owners = controls.where("tag = 'select'").select(F.col("page_id").alias("s_page"), F.col("node_id").alias("s_id"), F.col("last").alias("s_last"), a("name").alias("name"))
    chosen = texts(nodes, options).join(options.select(*KEY, a("value").alias("own")), KEY).join(owners, (F.col("page_id") == F.col("s_page")) & (F.col("node_id") > F.col("s_id")) & (F.col("node_id") <= F.col("s_last")))
    chosen = chosen.select(*KEY, "name", F.coalesce("own", "text_all").alias("value"))
    every = plain.unionByName(area).unionByName(chosen)
    return every.withColumn("value", F.regexp_replace("value", "\r?\n", "\r\n"))
