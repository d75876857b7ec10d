"""Syntax trees to DataFrame plans over a node table.

A test is a Column where the node's own row decides; relations are semi-joins, always with
equality on page_id, so Spark joins by hash or sort; positions are window functions per page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selector import NTH, POSITIONAL, SelectorError, Step, Test, parse

def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def _has(name: str) -> Column:
    return F.map_contains_key(F.col("attrs"), F.lit(name))


def _input(kind: str) -> Column:
    return (F.col("tag") == "input") & (F.lower(F.coalesce(_attr("type"), F.lit(""))) == kind)


def _nth(index: str, a: int, b: int) -> Column:
    f = F.col(index) - b
    return f == 0 if a == 0 else (F.pmod(f, F.lit(abs(a))) == 0) & (F.signum(f) * (1 if a > 0 else -1) >= 0)


#: Pseudo-classes that a node's own row decides, by name; ``register`` adds more.
PSEUDOS: dict[str, Callable[[object], Column]] = {
    "first-child": lambda _: F.col("elem_idx") == 1,
    "last-child": lambda _: F.col("elem_idx_rev") == 1,
    "only-child": lambda _: (F.col("elem_idx") == 1) & (F.col("elem_idx_rev") == 1),
    "first-of-type": lambda _: F.col("type_idx") == 1,
    "last-of-type": lambda _: F.col("type_idx_rev") == 1,
    "only-of-type": lambda _: (F.col("type_idx") == 1) & (F.col("type_idx_rev") == 1),
    "empty": lambda _: F.col("n_content_children") == 0,
    "parent": lambda _: F.col("n_content_children") > 0,
    "root": lambda _: F.col("parent_id").isNull(),
    "disabled": lambda _: _has("disabled"),
    "enabled": lambda _: F.col("tag").isin("input", "button", "select", "textarea", "option", "optgroup", "fieldset") & ~_has("disabled"),
    "checked": lambda _: (F.col("tag").isin("input") & _has("checked")) | ((F.col("tag") == "option") & _has("selected")),
    "selected": lambda _: (F.col("tag") == "option") & _has("selected"),
    "header": lambda _: F.col("tag").rlike("^h[1-6]$"),
    "input": lambda _: F.col("tag").isin("input", "select", "textarea", "button"),
    "button": lambda _: _input("button") | (F.col("tag") == "button"),
    "text": lambda _: (F.col("tag") == "input") & (F.lower(F.coalesce(_attr("type"), F.lit("text"))) == "text"),
    "submit": lambda _: F.col("tag").isin("input", "button") & (F.lower(F.coalesce(_attr("type"), F.lit(""))) == "submit"),
    "reset": lambda _: F.col("tag").isin("input", "button") & (F.lower(F.coalesce(_attr("type"), F.lit(""))) == "reset"),
    **{k: (lambda _, k=k: _input(k)) for k in ("radio", "checkbox", "file", "password", "image")},
}


def register(name: str, build: Callable[[object], Column]) -> None:
    """A pseudo-class of one's own: from its argument to a Column over a node's row."""
    parse.cache_clear()
    PSEUDOS[name.lower()] = build


def attribute_test(name: str, operator: str | None, value: str | None) -> Column:
    """Missing attributes match "!=" alone; "^=", "$=", "*=" and "~=" never match an empty value."""
    a = _attr(name)
    if operator is None:
        return _has(name)
    v = F.lit(value)
    if operator == "=":
        out = a == v
    elif operator == "!=":
        out = ~a.eqNullSafe(v)
    elif operator == "|=":
        out = (a == v) | a.startswith(f"{value}-")
    elif not value:
        out = F.lit(False)
    elif operator == "^=":
        out = a.startswith(value)
    elif operator == "$=":
        out = a.endswith(value)
    elif operator == "*=":
        out = a.contains(value)
    else:
        out = F.concat(F.lit(" "), F.regexp_replace(a, r"[\t\r\n\f]", " "), F.lit(" ")).contains(f" {value} ")
    return F.coalesce(out, F.lit(False))


def own_test(t: Test) -> Column | None:
    """The test as a Column, or None if it needs other rows."""
    if t.kind == "tag":
        return F.lit(True) if t.name == "*" else F.col("tag") == t.name
    if t.kind == "id":
        return F.coalesce(_attr("id") == t.name, F.lit(False))
    if t.kind == "class":
        return F.array_contains("classes", t.name)
    if t.kind == "attr":
        return attribute_test(t.name, t.operator, t.argument)
    if t.name in NTH:
        index = {"nth-child": "elem_idx", "nth-last-child": "elem_idx_rev", "nth-of-type": "type_idx", "nth-last-of-type": "type_idx_rev"}[t.name]
        return _nth(index, *t.argument)
    if t.name == "not":
        groups = [_own_step(g[0]) if len(g) == 1 else None for g in t.argument]
        return None if any(g is None for g in groups) else ~F.coalesce(reduce(lambda x, y: x | y, groups), F.lit(False))
    if t.name in PSEUDOS:
        return F.coalesce(PSEUDOS[t.name](t.argument), F.lit(False))
    return None


def _own_step(step: Step) -> Column | None:
    tests = [own_test(t) for t in step.tests]
    return None if any(t is None for t in tests) else reduce(lambda x, y: x & y, tests)


def relate(later: DataFrame, earlier: DataFrame, combinator: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``later`` that stand to a row of ``earlier`` as the combinator says."""
    e = earlier.select(*[F.col(c).alias(f"e_{c}") for c in ("page_id", "node_id", "last", "parent_id", "elem_idx")])
    same = F.col("page_id") == F.col("e_page_id")
    siblings = same & F.col("parent_id").eqNullSafe(F.col("e_parent_id"))
    on = {
        " ": same & (F.col("node_id") > F.col("e_node_id")) & (F.col("node_id") <= F.col("e_last")),
        ">": same & (F.col("parent_id") == F.col("e_node_id")),
        "+": siblings & (F.col("elem_idx") == F.col("e_elem_idx") + 1),
        "~": siblings & (F.col("elem_idx") > F.col("e_elem_idx")),
        "up": same & (F.col("node_id") < F.col("e_node_id")) & (F.col("last") >= F.col("e_node_id")),
        "is": same & (F.col("node_id") == F.col("e_node_id")),
    }[combinator]
    return later.join(e, on, how)


def texts(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(page_id, node_id, text_all): the text within each of the rows ``of``, in document order."""
    t = nodes.where("kind = 3").select(F.col("page_id").alias("t_page"), F.col("node_id").alias("t_id"), F.col("text").alias("t_text"))
    joined = of.select("page_id", "node_id", "last").join(t, (F.col("page_id") == F.col("t_page")) & (F.col("t_id") >= F.col("node_id")) & (F.col("t_id") <= F.col("last")), "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("t_id").isNotNull(), F.struct("t_id", "t_text"))))
    return joined.groupBy("page_id", "node_id").agg(F.array_join(F.transform(ordered, lambda x: x["t_text"]), "").alias("text_all"))


def positional(df: DataFrame, name: str, k: int | None) -> DataFrame:
    """Rows by their place in all that a page has matched so far, from 0; a negative place counts
    from the end."""
    w = Window.partitionBy("page_id")
    at, total = F.row_number().over(w.orderBy("node_id")) - 1, F.count("*").over(w)
    x = df.withColumn("at_", at).withColumn("total_", total)
    at, total = F.col("at_"), F.col("total_")
    place = None if k is None else F.lit(k) + (total if k < 0 else F.lit(0))
    keep = {
        "first": lambda: at == 0,
        "last": lambda: at == total - 1,
        "eq": lambda: at == place,
        "nth": lambda: at == place,
        "lt": lambda: at < place,
        "gt": lambda: at > place,
        "even": lambda: F.pmod(at, F.lit(2)) == 0,
        "odd": lambda: F.pmod(at, F.lit(2)) == 1,
    }[name]()
    return x.where(keep).drop("at_", "total_")


def _tested(matched: DataFrame, nodes: DataFrame, t: Test) -> DataFrame:
    if (own := own_test(t)) is not None:
        return matched.where(own)
    if t.name in POSITIONAL:
        return positional(matched, t.name, t.argument)
    if t.name == "not":
        return relate(matched, _groups(nodes, t.argument), "is", "left_anti")
    if t.name == "has":
        return relate(matched, _groups(nodes, t.argument), "up")
    if t.name == "contains":
        found = texts(nodes, matched).where(F.col("text_all").contains(t.argument)).select(F.col("page_id").alias("f_page"), F.col("node_id").alias("f_id"))
        return matched.join(found, (F.col("page_id") == F.col("f_page")) & (F.col("node_id") == F.col("f_id")), "left_semi")
    if t.name == "lang":
        up = nodes.where(_has("lang")).select(F.col("page_id").alias("u_page"), F.col("node_id").alias("u_id"), F.col("last").alias("u_last"), F.lower(_attr("lang")).alias("u_lang"))
        nearest = matched.select("page_id", "node_id").join(up, (F.col("page_id") == F.col("u_page")) & (F.col("u_id") <= F.col("node_id")) & (F.col("u_last") >= F.col("node_id")))
        nearest = nearest.groupBy("page_id", "node_id").agg(F.max_by("u_lang", "u_id").alias("lang"))
        want = t.argument.lower()
        found = nearest.where((F.col("lang") == want) | F.col("lang").startswith(f"{want}-")).select(F.col("page_id").alias("f_page"), F.col("node_id").alias("f_id"))
        return matched.join(found, (F.col("page_id") == F.col("f_page")) & (F.col("node_id") == F.col("f_id")), "left_semi")
    raise SelectorError(f"unsupported pseudo: {t.name}")


def _group(nodes: DataFrame, steps: tuple[Step, ...], context: DataFrame | None) -> DataFrame:
    elements = nodes.where("kind = 1")
    matched = None
    for step in steps:
        own = [t for t in step.tests if own_test(t) is not None]
        rows = elements
        for t in own if not any(t.name in POSITIONAL for t in step.tests) else ():
            rows = rows.where(own_test(t))  # both sides are filtered before they are joined
        if step.combinator:
            rows = relate(rows, matched, step.combinator)
        elif context is not None:
            rows = relate(rows, context, " ")
        for t in step.tests:
            if rows is not None and (t not in own or any(x.name in POSITIONAL for x in step.tests)):
                rows = _tested(rows, nodes, t)
        matched = rows
    return matched


def _groups(nodes: DataFrame, groups: tuple[tuple[Step, ...], ...], context: DataFrame | None = None) -> DataFrame:
    if all(len(g) == 1 for g in groups):  # one scan, if each node's row decides
        tests = [_own_step(g[0]) for g in groups]
        if all(t is not None for t in tests):
            rows = nodes.where("kind = 1").where(reduce(lambda x, y: x | y, tests))
            return rows if context is None else relate(rows, context, " ")
    found = [_group(nodes, g, context) for g in groups]
    out = reduce(lambda x, y: x.unionByName(y), found)
    return out if len(found) == 1 else out.dropDuplicates(["page_id", "node_id"])


def select(nodes: DataFrame, selector: str, context: DataFrame | None = None) -> DataFrame:
    """Elements that the selector matches, each once; in ``context``, descendants of its rows.
    Order is (page_id, node_id), to be asked for with orderBy where it matters."""
    return _groups(nodes, parse(selector), context)
