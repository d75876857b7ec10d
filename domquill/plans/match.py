"""Selectors held against one parsed page, inside the pass that parses it.

A page is bounded, so matching it where it is parsed needs no join and no shuffle. ``compile`` has
the same language over stored node tables; tests hold one against the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .selector import NTH, POSITIONAL, SelectorError, Step, Test, parse

ELEMENT, TEXT = 1, 3
FORM = frozenset("input select textarea button".split())
ENABLED = FORM | {"option", "optgroup", "fieldset"}


def _type(r: dict, other: str = "") -> str:
    return (r["attrs"].get("type", other)).lower()


#: Pseudo-classes that a node's own row decides, as in ``compile.PSEUDOS``.
OWN: dict[str, Callable[[dict], bool]] = {
    "first-child": lambda r: r["elem_idx"] == 1,
    "last-child": lambda r: r["elem_idx_rev"] == 1,
    "only-child": lambda r: r["elem_idx"] == r["elem_idx_rev"] == 1,
    "first-of-type": lambda r: r["type_idx"] == 1,
    "last-of-type": lambda r: r["type_idx_rev"] == 1,
    "only-of-type": lambda r: r["type_idx"] == r["type_idx_rev"] == 1,
    "empty": lambda r: not r["n_content_children"],
    "parent": lambda r: r["n_content_children"] > 0,
    "root": lambda r: r["parent_id"] is None,
    "disabled": lambda r: "disabled" in r["attrs"],
    "enabled": lambda r: r["tag"] in ENABLED and "disabled" not in r["attrs"],
    "checked": lambda r: (r["tag"] == "input" and "checked" in r["attrs"]) or (r["tag"] == "option" and "selected" in r["attrs"]),
    "selected": lambda r: r["tag"] == "option" and "selected" in r["attrs"],
    "header": lambda r: re.fullmatch("h[1-6]", r["tag"]) is not None,
    "input": lambda r: r["tag"] in FORM,
    "button": lambda r: r["tag"] == "button" or (r["tag"] == "input" and _type(r) == "button"),
    "text": lambda r: r["tag"] == "input" and _type(r, "text") == "text",
    **{k: (lambda r, k=k: r["tag"] in ("input", "button") and _type(r) == k) for k in ("submit", "reset")},
    **{k: (lambda r, k=k: r["tag"] == "input" and _type(r) == k) for k in ("radio", "checkbox", "file", "password", "image")},
}
_INDEX = {"nth-child": "elem_idx", "nth-last-child": "elem_idx_rev", "nth-of-type": "type_idx", "nth-last-of-type": "type_idx_rev"}


def _attribute(r: dict, t: Test) -> bool:
    a, v = r["attrs"].get(t.name), t.argument
    if t.operator is None:
        return a is not None
    if t.operator == "!=":
        return a != v
    if a is None:
        return False
    if t.operator == "=":
        return a == v
    if t.operator == "|=":
        return a == v or a.startswith(f"{v}-")
    if not v:
        return False
    if t.operator == "~=":
        return f" {v} " in f" {re.sub(r'[\t\r\n\f]', ' ', a)} "
    return a.startswith(v) if t.operator == "^=" else a.endswith(v) if t.operator == "$=" else v in a


class Page:
    """The nodes of a page (see ``sources.html.parse_html``), and sets of them as ordered numbers."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.elements = [r["node_id"] for r in rows if r["kind"] == ELEMENT]
        self.before: dict[int, int | None] = {}  # an element's previous element sibling
        last: dict[int | None, int] = {}
        for k in self.elements:
            up = rows[k]["parent_id"]
            self.before[k] = last.get(up)
            last[up] = k

    def text(self, k: int) -> str:
        return "".join(r["text"] for r in self.rows[k : self.rows[k]["last"] + 1] if r["kind"] == TEXT)

    def ancestors(self, k: int):
        k = self.rows[k]["parent_id"]
        while k is not None:
            yield k
            k = self.rows[k]["parent_id"]

    def siblings_before(self, k: int):
        k = self.before[k]
        while k is not None:
            yield k
            k = self.before[k]

    def select(self, groups: tuple[tuple[Step, ...], ...]) -> list[int]:
        found: set[int] = set()
        for steps in groups:
            found.update(self._group(steps))
        return sorted(found)

    def _group(self, steps: tuple[Step, ...]) -> list[int]:
        matched: list[int] = []
        for step in steps:
            rows, positional = self.elements, any(t.name in POSITIONAL and t.kind == "pseudo" for t in step.tests)
            for t in () if positional else step.tests:  # what decides most comes first
                rows = self._tested(rows, t)
            if step.combinator:
                rows = self._related(rows, frozenset(matched), step.combinator)
            for t in step.tests if positional else ():
                rows = self._tested(rows, t)
            matched = rows
        return matched

    def _related(self, rows: list[int], to: frozenset[int], combinator: str) -> list[int]:
        near = {
            " ": lambda k: any(a in to for a in self.ancestors(k)),
            ">": lambda k: self.rows[k]["parent_id"] in to,
            "+": lambda k: self.before[k] in to,
            "~": lambda k: any(b in to for b in self.siblings_before(k)),
        }[combinator]
        return [k for k in rows if near(k)]

    def _tested(self, rows: list[int], t: Test) -> list[int]:
        if t.kind == "pseudo" and t.name in POSITIONAL:
            n, k = len(rows), t.argument
            k = k + n if k is not None and k < 0 else k
            keep = {
                "first": lambda i: i == 0,
                "last": lambda i: i == n - 1,
                "eq": lambda i: i == k,
                "nth": lambda i: i == k,
                "lt": lambda i: i < k,
                "gt": lambda i: i > k,
                "even": lambda i: i % 2 == 0,
                "odd": lambda i: i % 2 == 1,
            }[t.name]
            return [x for i, x in enumerate(rows) if keep(i)]
        if t.kind == "pseudo" and t.name in ("not", "has"):
            other = set(self.select(t.argument))
            if t.name == "not":
                return [k for k in rows if k not in other]
            holds = {a for k in other for a in self.ancestors(k)}
            return [k for k in rows if k in holds]
        return [k for k in rows if self._holds(k, t)]

    def _holds(self, k: int, t: Test) -> bool:
        r = self.rows[k]
        if t.kind == "tag":
            return t.name == "*" or r["tag"] == t.name
        if t.kind == "id":
            return r["attrs"].get("id") == t.name
        if t.kind == "class":
            return t.name in r["classes"]
        if t.kind == "attr":
            return _attribute(r, t)
        if t.name in NTH:
            a, b = t.argument
            f = r[_INDEX[t.name]] - b
            return f == 0 if not a else f % abs(a) == 0 and f * a >= 0
        if t.name == "contains":
            return t.argument in self.text(k)
        if t.name == "lang":
            own = next((x for x in (self.rows[a]["attrs"].get("lang") for a in (k, *self.ancestors(k))) if x is not None), None)
            want = t.argument.lower()
            return own is not None and (own.lower() == want or own.lower().startswith(f"{want}-"))
        if t.name in OWN:
            return OWN[t.name](r)
        raise SelectorError(f"unsupported pseudo: {t.name}")


@lru_cache(maxsize=256)
def matchable(selector: str) -> bool:
    """Whether all of a selector can be decided here: pseudo-classes of one's own are Columns."""

    def known(t: Test) -> bool:
        if t.kind != "pseudo" or t.name in POSITIONAL or t.name in NTH or t.name in OWN or t.name in ("contains", "lang"):
            return True
        return t.name in ("not", "has") and all(known(x) for g in t.argument for s in g for x in s.tests)

    return all(known(t) for g in parse(selector) for s in g for t in s.tests)
