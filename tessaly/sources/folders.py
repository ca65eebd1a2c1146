"""The folder all executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a session on this machine alone may do without: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessaly-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one. It is removed when the application ends."""
    path = f"{shared_root(spark)}/tessaly/{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run within go as each of them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREES_SHUFFLES)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def store(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes rows as densely packed Parquet; the shuffle files behind them are not kept."""
    with freed_shuffles(rows.sparkSession):
        rows.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Intermediate tables that no later step reads."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(rows: DataFrame, label: str) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back."""
    spark = rows.sparkSession
    path = new_folder(spark, label)
    with freed_shuffles(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
