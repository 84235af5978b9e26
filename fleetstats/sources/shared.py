"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a local folder in local mode, else an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/fleetstats-{context.applicationId}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession) -> str:
    """A new folder among the shared ones, for the session."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def unsorted(spark: SparkSession, folders: int) -> Iterator[None]:
    """Writes to partitions don't sort their rows as long as a task has no more than ``folders`` of them, so long rows aren't held back."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, folders)
    try:
        yield
    finally:
        spark.conf.set(name, before)
