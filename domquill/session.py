"""What a session's Python workers need, and tables in the folder that all of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if that place is theirs
    too; on a cluster it is installed or shipped like any package."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the folder that spark.checkpoint.dir names and read again, for plans
    that read it several times. Only a session that runs in one process gets a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='domquill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/domquill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
