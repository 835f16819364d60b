"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of an Arrow batch on its way to Python.
BATCH = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own
    where the session names none (as in tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs one stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back()  # what the driver has collected before
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark's cleaner removes shuffles, checkpoints and broadcasts of finished jobs from
    the executors only once the driver's JVM has collected the last reference to them."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends Arrow batches of about ``BATCH`` bytes to Python. By default 10,000 rows make a batch: with
    long texts tens of MB, held by each worker and, in buffers that double, outside the heap of the executor. No result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def least_by_hash(rows: DataFrame, k: int, key: list[str]) -> DataFrame:
    """The ``k`` rows of least hash of ``key``. Rows that cannot be among them (hashes spread evenly, so a few
    times the share suffices) go before the sort."""
    share = min(1.0, 4 * k / max(1, rows.count()))
    hashed = F.xxhash64(*key)
    near = F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return rows.where(near).orderBy(F.pmod(hashed, F.lit(1 << 30)), *key).limit(k)


def lean(run):
    """The generator ``run(batches)`` of a Python task, which gives freed memory back to the system at its end:
    Spark keeps workers for later tasks, and what their allocators hold counts on the executor."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in order; none for a null or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
