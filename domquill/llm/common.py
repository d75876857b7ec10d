"""What the operators share: tables that cut lineage, batches for Python, and bounds on what is
broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_package

#: Upper-case ASCII to lower case, and nothing else; the contracts lower-case A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows that a Python stage takes at once; Spark bounds what it sends it by bytes.
ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where no folder is named and driver and executors are one process (as in tests) one is
    made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='domquill-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/domquill/{name}-{uuid.uuid4().hex}"


@contextmanager
def one_step(spark: SparkSession) -> Iterator[None]:
    """What runs inside is a step that ends in a table: Spark deletes its shuffle files at its end,
    as nothing reads them again. The session's own setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there and a lost
    executor costs no more than the tasks it was running."""
    path = new_table_path(df.sparkSession, name)
    with one_step(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` returned, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)


class Bucketed:
    """A written table bucketed by a column: steps that need rows of one value together read them
    where they lie and don't shuffle them again. Its name in the catalog is its own."""

    def __init__(self, made: DataFrame, by: str, buckets: int, compression: str = "snappy"):
        self.spark = made.sparkSession
        self.name, self.path = f"domquill_{uuid.uuid4().hex}", new_table_path(self.spark, "bucketed")
        with one_step(self.spark):
            made.write.format("parquet").option("compression", compression).bucketBy(buckets, by).option("path", self.path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalog; frames that were made can still read the files."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def drop(self) -> None:
        self.forget()
        delete_folder(self.spark, self.path)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = ROWS) -> DataFrame:
    """``df.mapInArrow(f, schema)`` whose batches have ``rows`` rows at most. Spark ends a batch at
    spark.sql.execution.arrow.maxBytesPerBatch, so a worker's memory doesn't follow text length;
    none of the session's settings is changed."""
    reach_package(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def utf8(text: Column) -> Column:
    """A text's UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held(value: Column) -> Column:
    """``value``, worked out once a row. The optimizer copies a deterministic expression into each
    place that reads it, the body of an array function too, where it would then run once an
    element; it copies none that
    depends on the row's number."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


#: Numbers (of 8 bytes, with some tens of bytes around each row) that one broadcast holds at most.
BROADCAST_NUMBERS = 2_000_000


def small(df: DataFrame, numbers: int) -> DataFrame:
    """``df``, to be broadcast if its counted ``numbers`` are within the bound, else joined by
    shuffle."""
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df
