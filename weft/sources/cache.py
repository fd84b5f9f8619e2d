"""Intermediate tables that later steps and later runs read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weft-scratch")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: computed once however often it is used."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, folder: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` for ``key`` (a fingerprint of what it depends on), made and written only if it isn't there.

    A table without Spark's marker of success was not finished and is written again.
    """
    path = f"{folder.rstrip('/')}/{name}-{key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
