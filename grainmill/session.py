"""The shared folder for written intermediate results, and who removes them."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder shared by all executors")
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written to yet.

    It goes when the application ends, if nobody removes it before.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove folders made by ``new_folder`` that no result reads any more."""
    for path in paths:
        files, place = _file_system(spark, path.removesuffix("/data"))
        files.delete(place, True)


def settle(df: DataFrame, owner: Scratch | None = None) -> DataFrame:
    """Write an intermediate result once, so later steps read the same rows.

    The Parquet files are in the shared folder and survive the loss of any
    executor. Unlike a checkpoint, this computes the rows only once. An owner
    removes them when it closes, else they stay until the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    if owner is not None:
        owner.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only finished jobs have used.

    Spark removes them when the driver's garbage is collected, which a small
    driver may not need for a long time.
    """
    gc.collect()
    spark._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Let the executors collect their garbage and give back the heap that they no longer need.

    A heap that one step has made large stays so, beside the Python workers of
    the steps that follow. One task a core asks for it, so that none is left out.
    """
    cores = spark.sparkContext.defaultParallelism
    asked = F.expr("java_method('java.lang.System', 'gc')").alias("asked")
    spark.range(0, cores, 1, cores).select(asked).agg(F.count("asked")).collect()


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers get their rows in batches of BATCH_BYTES or so, if the session has no limit of its own.

    By default a batch takes 10,000 rows or 64 MB. Workers and the JVM keep
    the memory of their largest batch for the steps that follow.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


class Scratch:
    """Owner of the settled results of one call: ``with Scratch(spark) as scratch``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def settle(self, df: DataFrame) -> DataFrame:
        return settle(df, self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, *self.paths)
        self.paths.clear()
