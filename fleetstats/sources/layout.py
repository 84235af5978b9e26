"""History and latest reports laid out for statistics of the whole history: by month and, within it, by device.

Both tables are bucketed alike by device, so counting distinct devices of a month and joining the history to the latest reports need no shuffle, and a
cut by month leaves out whole folders. A layout is replaced by one commit.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import clean, commit, last_commit, new_path

BUCKETS = 64


def by_month(history: DataFrame, time: str = "ts") -> DataFrame:
    """``history`` with the first day of the month of each report."""
    return history.withColumn("month", F.to_date(F.date_trunc("month", F.timestamp_millis(time))))


def lay_out(folder: str, tables: dict[str, DataFrame], buckets: int = BUCKETS, device: str = "uuid") -> None:
    """Write ``tables``, bucketed by ``device`` and, if they have one, in folders by ``month``, in the place of those in ``folder``."""
    spark = next(iter(tables.values())).sparkSession
    after, _ = last_commit(spark, folder)
    content = {}
    for name, df in tables.items():
        path, made = new_path(folder), f"laid_{uuid.uuid4().hex}"
        # A task for each bucket, which writes one file a month.
        writer = df.repartition(buckets, device).write.format("parquet").option("path", path).bucketBy(buckets, device).sortBy(device)
        (writer.partitionBy("month") if "month" in df.columns else writer).saveAsTable(made)
        spark.sql(f"DROP TABLE {made}")  # the data stay
        content[name] = {"path": path, "schema": df.schema.jsonValue(), "buckets": buckets, "device": device}
    commit(spark, folder, content, after)
    clean(spark, folder)


def laid_out(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last layout, known to this session as one with buckets."""
    table = last_commit(spark, folder)[1][name]
    known = f"laid_{hashlib.md5(table['path'].encode()).hexdigest()}"
    if not spark.catalog.tableExists(known):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(table["schema"]).fields)
        months = "PARTITIONED BY (month)" if "`month` date" in columns else ""
        spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet {months} CLUSTERED BY ({table['device']}) SORTED BY ({table['device']}) INTO {table['buckets']} BUCKETS LOCATION '{table['path']}'")
        if months:
            spark.catalog.recoverPartitions(known)
    return spark.table(known)
