"""Contiguous shards of near equal bytes, from prefix sums over the whole input. Native Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", blocks: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``: shards are contiguous in order of ``key``.

    Rows are range-partitioned by key into blocks; a total per block gives each block its global
    byte and row offset (one row per block, so the driver's side stays bounded by ``blocks``, a
    plan setting), a running sum inside the block gives each row its own. A row goes to the shard
    in whose n-th part of all bytes its midpoint lies, so a shard is off its target by less than
    one row at either end.

    A null text has size 1 (its terminator), so has an empty one; texts of any length are measured
    whole; null keys come first; rows of equal key are ordered by their text's hash, and rows equal
    in both are interchangeable. ``columns`` are what comes along, all by default; a text that is
    only measured needn't be moved. Columns of ``docs`` named size, shard or slot are replaced,
    others keep their names whatever those are. An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in (columns or docs.columns) if c not in ("size", "shard", "slot")]
    sized = docs.select(
        F.struct(*own).alias("row"),
        docs[key].alias("k"),
        F.xxhash64(docs[text]).alias("tie"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1).alias("size"),
    )
    # Texts are measured once, in their scan; what is sampled for ranges and moved is slim. Hash and
    # row number are in the range key as well: a key or a text that a third of the rows share is split.
    slim = cut(sized.withColumn("nth", F.monotonically_increasing_id()), "shard-sizes")
    order = (F.col("k").asc_nulls_first(), F.col("tie"), F.col("nth"))
    placed = cut(slim.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "shard-blocks")
    drop_table(slim)
    totals = placed.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("block").orderBy(*order)
    middle = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    ranked = placed.join(F.broadcast(offsets), "block").select(
        "row",
        "size",
        F.least(F.floor(middle * n_shards / F.col("all_bytes")), F.lit(n_shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("global_row"),
    )
    first = ranked.groupBy("shard").agg(F.min("global_row").alias("first_row"))
    return ranked.join(F.broadcast(first), "shard").select("row.*", "size", "shard", (F.col("global_row") - F.col("first_row")).alias("slot"))
