"""Append-only facts: batches that are written once, whatever fails or runs again.

A batch is written into a folder of its own attempt, by a date part; what makes it count is its manifest, one small file with the
attempt and the rows of each part, written last. An attempt without a manifest is never read. A batch with a manifest is not written again."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "attempt string, part date, n long, batch string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, attempt, part, n)`` of every batch that counts."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("attempt is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)  # no batch yet


def write_attempt(rows: DataFrame, path: str, batch: str, by: str = "recorded_at", every: str = "day") -> str:
    """Write the rows of a batch by day (or month) of ``by``; they do not count yet. Returns the attempt."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch is named by letters, digits, dots and hyphens")
    attempt = uuid.uuid4().hex
    part = F.to_date(by) if every == "day" else F.trunc(F.to_date(by), every)
    rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{path}/data/batch={batch}/attempt={attempt}")
    return attempt


def append_batch(rows: DataFrame, path: str, batch: str, by: str = "recorded_at", every: str = "day") -> bool:
    """Append a batch; False, and nothing changes, if it is there. Rows without a date go to a part of their own. An empty batch counts
    as there afterwards. Of two runs of a batch at the same time the one whose manifest is last counts."""
    spark = rows.sparkSession
    if not manifests(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    attempt = write_attempt(rows, path, batch, by, every)
    schema = T.StructType([*rows.schema, T.StructField("part", T.DateType())])
    written = spark.read.schema(schema).parquet(f"{path}/data/batch={batch}/attempt={attempt}").groupBy("part").agg(F.count("*").alias("n"))
    none = spark.createDataFrame([(None, 0)], "part date, n long")
    summed = written.unionByName(none).groupBy("part").agg(F.sum("n").alias("n"))  # a row at least
    summed.select(F.lit(attempt).alias("attempt"), "part", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    return True


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that count, with ``batch`` and ``part``."""
    full = T.StructType([*schema, *[T.StructField(c, T.StringType()) for c in ("batch", "attempt")], T.StructField("part", T.DateType())])
    counts = manifests(spark, path).where("n > 0").select("batch", "attempt").distinct()
    if counts.isEmpty():
        return spark.createDataFrame([], full).drop("attempt")
    return spark.read.schema(full).parquet(f"{path}/data").join(counts, ["batch", "attempt"], "left_semi").drop("attempt")
