"""Operators on ordered rows: positions, cycles, classes, joins by a literal table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_class(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``row_class``: "first" for each third row if there are three, then "odd" or
    "even" by the place from 1 if there is more than one row."""
    w = Window.partitionBy(*by)
    at, total = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    first = F.when((total >= 3) & (F.pmod(at, F.lit(3)) == 0), "first")
    odd = F.when(total > 1, F.when(F.pmod(at + 1, F.lit(2)) == 1, "odd").otherwise("even"))
    return df.withColumn("row_class", F.concat_ws(" ", first, odd))


def number_lines(df: DataFrame, text: str) -> DataFrame:
    """A row per line: the columns of ``df`` with ``line_no`` from 1 and ``line``."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n"))).withColumn("line_no", F.col("pos") + 1).withColumnRenamed("col", "line").drop("pos")


def cycle(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``next`` and ``prev``: the neighbours' values, round the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.count("*").over(Window.partitionBy(*by)) == F.row_number().over(w)
    first = F.row_number().over(w) == 1
    following = F.when(last, F.first(value).over(all_)).otherwise(F.lead(value).over(w))
    before = F.when(first, F.last(value).over(all_)).otherwise(F.lag(value).over(w))
    return df.withColumn("next", following).withColumn("prev", before)


def union_in_order(*sources: DataFrame) -> DataFrame:
    """All rows, repeats kept, with ``source`` (which frame) for an order that holds."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return out


def ordered_concat(df: DataFrame, by: list[str], order: list[str], value: str, sep: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[value]), sep).alias("joined"))


def sort_namespaces(ns: Column) -> Column:
    return F.array_join(F.array_sort(F.split(ns, r"\.")), ".")


def grep(df: DataFrame, keep: Column, invert: bool = False) -> DataFrame:
    """Rows for which ``keep`` holds, or all others; what is null doesn't hold."""
    held = F.coalesce(keep, F.lit(False))
    return df.where(~held if invert else held)


def distinct_in_order(df: DataFrame, *order: str) -> DataFrame:
    """Each row once, in order."""
    return df.dropDuplicates().orderBy(*order)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either, each once."""
    return a.unionByName(b).distinct()


def among(df: DataFrame, other: DataFrame, on: str, invert: bool = False) -> DataFrame:
    """Rows whose value is one of the other frame's, or is none of them; nulls are no value."""
    keys = other.select(F.col(on).alias("other_"))
    return df.join(keys, F.col(on) == F.col("other_"), "left_anti" if invert else "left_semi")


def rewrite_by_key(df: DataFrame, text: str, urls: str) -> DataFrame:
    """Each entry's short address in the same row's text replaced by its long one, if it has one."""
    return df.withColumn(text, F.aggregate(F.col(urls), F.col(text), lambda acc, u: F.coalesce(F.replace(acc, u["url"], u["expanded_url"]), acc)))
