"""A training corpus from documents: quality, line dedup, near dedup, decontamination, packing.

Every stage works on all that the one before kept, takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents. Extra columns come along as they are,
whatever their names, but for the last stage. Nulls in any column, empty and very long texts, ties
and repeated rows are handled as the operators' docstrings say; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domquill.llm import decontamination, line_dedup, near_dedup, packing, quality
from domquill.llm.common import cut, drop_table, read
from domquill.llm.queries import held_out, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.3 or more, as its query does. Null and empty texts are
    scored like others, repeated rows alike; labels of null keys, or null ones, aren't learnt from."""
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~held_out(5)))
    return quality.score(docs, model, keep_from=0.3)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated passages; those of which nothing is left go. ``n_chars`` follows
    the text where it changed. Null and empty texts stay as they are; rows of equal key and text
    get the same result; the occurrence first in order of key, null first, stays."""
    counts = ("n_lines", "n_removed")
    while set(counts) & set(docs.columns):  # names that no column has
        counts = tuple(f"{c}_" for c in counts)
    done = line_dedup.dedup_lines(docs, drop_emptied=True, counts=counts)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the one with the smallest key, null
    keys last. Texts without words all stay; different texts under one key stay."""
    return near_dedup.one_of_each(docs, n=5, similarity=0.8)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs. Null texts have no
    words and stay."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), n=10, remove="documents")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 1024 tokens; null and empty texts
    have their end token, repeated rows a piece each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold each against a plain version of its operator's rule, the
#: classifier's by the rows it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop_table(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
