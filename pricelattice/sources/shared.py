"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; under a temporary one where the session names none (as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` written as Parquet, by ``parts``, and read back."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
