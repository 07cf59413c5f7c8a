"""Intermediate tables in the folder that all executors share, ``spark.checkpoint.dir``.

Where that is unset, a temporary folder is made if the master is local; on a cluster
it would lie on the driver's machine alone, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def saver(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table under a fresh folder and rereads it."""
    root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{table}")
        return spark.read.parquet(f"{root}/{table}")

    return save


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
