"""Events: subscriptions, namespaces, delegation, once, debounce and toggles, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(events: DataFrame, types: str = "event_type") -> DataFrame:
    """``events`` with ``type`` and ``namespaces`` (sorted) from "type.ns1.ns2"."""
    part = F.split(types, r"\.")
    return events.withColumn("type", F.get(part, F.lit(0))).withColumn("namespaces", F.array_sort(F.slice(part, 2, F.size(part))))


def matches(event_ns: Column, handler_ns: Column) -> Column:
    """A trigger's namespaces must all be the handler's; a trigger without any fits all."""
    return F.size(F.array_except(event_ns, handler_ns)) <= 0


def subscribe(events: DataFrame, types: str) -> DataFrame:
    """Events of any of the types, given as "click.menu view"; works on a stream."""
    return events.where(_any_of(types))


def _any_of(types: str) -> Column:
    keep = F.lit(False)
    for name, *ns in (t.split(".") for t in types.split()):
        has = F.lit(True) if not ns else F.size(F.array_except(F.array(*map(F.lit, ns)), F.col("namespaces"))) <= 0
        keep = keep | (F.col("type") == name) & has
    return keep


def unsubscribe(events: DataFrame, types: str) -> DataFrame:
    """Events of none of the types; works on a stream."""
    return events.where(~F.coalesce(_any_of(types), F.lit(False)))


def off(handlers: DataFrame, types: str = "", selector: str | None = None, handler_id: int | None = None) -> DataFrame:
    """``handlers`` (see ``dispatch``) less those that fit all that is given: one of the types with its
    namespaces ("click.menu", ".menu"), the selector ("**" for any), the handler."""
    gone = F.lit(True) if not types else F.lit(False)
    for t in types.split():
        name, *ns = t.split(".")
        own = F.lit(True) if not name else F.col("type") == name
        gone = gone | own & (F.size(F.array_except(F.array(*map(F.lit, ns)).cast("array<string>"), F.col("namespaces"))) <= 0)
    if selector is not None:
        gone = gone & (F.col("selector").isNotNull() if selector == "**" else F.col("selector").eqNullSafe(F.lit(selector)))
    if handler_id is not None:
        gone = gone & (F.col("handler_id") == handler_id)
    return handlers.where(~F.coalesce(gone, F.lit(False)))


def bubble(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, node_id, hop): where an event at a target passes, the target first, then outwards."""
    up = nodes.select(F.col("page_id").alias("n_page"), F.col("node_id"), F.col("last").alias("at_last"))
    path = events.join(up, (F.col("page_id") == F.col("n_page")) & (F.col("node_id") <= F.col("target_id")) & (F.col("at_last") >= F.col("target_id")))
    return path.select("event_id", "node_id", (F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("node_id"))) - 1).alias("hop"))


def input_fields(events: DataFrame) -> DataFrame:
    """``events`` with ``which`` (the key's code, else the character's; or the button: 1 left, 2 middle,
    3 right, from a mask of 1, 4 and 2), and ``page_x``, ``page_y`` (where not given, the place in the
    window and how far it is scrolled)."""
    button = F.col("button").cast("int")
    pressed = F.when(button.bitwiseAND(1) != 0, 1).when(button.bitwiseAND(2) != 0, 3).when(button.bitwiseAND(4) != 0, 2).otherwise(0)
    which = F.coalesce(F.col("which"), F.col("char_code"), F.col("key_code"), F.when(button.isNotNull(), pressed))
    place = lambda given, client, scroll: F.coalesce(F.col(given), F.col(client) + F.coalesce(F.col(scroll), F.lit(0)))
    return events.withColumn("which", which).withColumn("page_x", place("page_x", "client_x", "scroll_x")).withColumn("page_y", place("page_y", "client_y", "scroll_y"))


def once(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each key's first event."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return events.withColumn("rn_", first).where("rn_ = 1").drop("rn_")


def once_stream(events: DataFrame, by: list[str], time: str, watermark: str) -> DataFrame:
    """The same on a stream: a key's events within the watermark's reach count as one."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(by)


def dispatch(events: DataFrame, handlers: DataFrame, nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """Which handlers run for which events, in which order.

    ``events``: (event_id, page_id, target_id, type, namespaces); ``handlers``: (handler_id, type,
    namespaces, node_id or null, selector or null, stops), small by nature as they are written by
    hand; ``matched``: (page_id, node_id, selector) of the selectors that handlers delegate to.
    A handler runs at each of the target's ancestors (itself included) that it is bound to or
    whose selector matches; innermost first, at one node delegated ones before direct ones, then
    by id; nothing after the first that stops.
    """
    up = nodes.select(F.col("page_id").alias("n_page"), F.col("node_id").alias("at_id"), F.col("last").alias("at_last"), F.col("depth").alias("at_depth"))
    path = events.join(up, (F.col("page_id") == F.col("n_page")) & (F.col("at_id") <= F.col("target_id")) & (F.col("at_last") >= F.col("target_id"))).drop("n_page")
    h = handlers.select("handler_id", F.col("type").alias("h_type"), F.col("namespaces").alias("h_ns"), F.col("node_id").alias("h_node"), "selector", "stops")
    fits = matches(F.col("namespaces"), F.col("h_ns"))
    direct = path.join(h.where("selector is null"), (F.col("type") == F.col("h_type")) & (F.col("at_id") == F.col("h_node"))).where(fits).withColumn("delegated", F.lit(False))
    m = matched.select(F.col("page_id").alias("m_page"), F.col("node_id").alias("m_id"), F.col("selector").alias("m_selector"))
    bound = path.join(m, (F.col("page_id") == F.col("m_page")) & (F.col("at_id") == F.col("m_id")))
    delegated = bound.join(h.where("selector is not null"), (F.col("type") == F.col("h_type")) & (F.col("selector") == F.col("m_selector"))).where(fits).drop("m_page", "m_id", "m_selector").withColumn("delegated", F.lit(True))
    runs = direct.unionByName(delegated)
    order = Window.partitionBy("event_id").orderBy(F.col("at_depth").desc(), F.col("delegated").desc(), "handler_id")
    runs = runs.withColumn("seq", F.row_number().over(order)).withColumn("stop_at", F.min(F.when(F.col("stops"), F.col("seq"))).over(Window.partitionBy("event_id")))
    kept = F.row_number().over(order)
    return runs.where(F.col("stop_at").isNull() | (F.col("seq") <= F.col("stop_at"))).select("event_id", "handler_id", F.col("at_id").alias("node_id"), "delegated", kept.alias("seq"))


def debounce(events: DataFrame, by: list[str], time: str, gap: str, value: str) -> DataFrame:
    """The last value of each burst: events less than ``gap`` apart are one; of several at the last
    time the largest value; works on a stream with a watermark on ``time``."""
    last = F.max(F.struct(F.col(time).alias("at"), F.col(value).alias("value")))
    return events.groupBy(*by, F.session_window(time, gap)).agg(last.alias("last")).select(*by, F.col("last.value").alias(value), F.col("last.at").alias("at"))


def toggle_state(events: DataFrame, by: list[str], is_show: Column, is_hide: Column, time: str) -> DataFrame:
    """(by, shown): each key's state after its last show or hide; of several at one time a show wins."""
    told = F.when(is_show, True).when(is_hide, False)
    return events.where(told.isNotNull()).groupBy(*by).agg(F.max(F.struct(F.col(time).alias("at"), told.alias("shown"))).alias("last")).select(*by, F.col("last.shown").alias("shown"))


def toggle_fold(told: Column, transition: int) -> Column:
    """The state (shown) after a key's shows and hides, given as array<struct<at long, show boolean>>:
    nothing counts that says what is so already, or comes within ``transition`` of the last change."""
    start = F.struct(F.lit(False).alias("shown"), F.lit(None).cast("long").alias("free"))

    def step(state: Column, e: Column) -> Column:
        skip = (e["show"] == state["shown"]) | F.coalesce(e["at"] < state["free"], F.lit(False))
        return F.when(skip, state).otherwise(F.struct(e["show"].alias("shown"), (e["at"] + transition).alias("free")))

    return F.aggregate(F.array_sort(told), start, step)["shown"]
