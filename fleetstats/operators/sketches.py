"""Devices per month, approximately, from stored sketches; opt-in, exact counts are ``history.unique_by_month``.

A month's sketch is the union of those of its parts, so new reports add a small sketch each time and old ones aren't read again. The population without
Docker is decided by the latest reports: their Docker devices are one more sketch, which is taken away from each month's.
Counts are exact up to 2 to the power of ``size`` devices; beyond, the standard error is about one part in the root of that number.
With ``shards`` a month has so many sketches, each of the devices of one hash, and counts are exact as long as no shard has more devices than that.
A sketch takes up only what its devices need, 8 bytes each, so a large ``size`` costs nothing until it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import clean, commit, described, grown, last_commit, new_path, opened
from .history import MONTHS, first_month, zero_filled

SIZE = 14
#: The largest size there is, and shards so that a task holds little at once: exact up to about 6e10 devices a month, apart from equal 64-bit hashes.
EXACT_SIZE, EXACT_SHARDS = 26, 1024


def _shard(device: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(device), F.lit(shards)).cast("int")


def month_sketches(history: DataFrame, size: int = SIZE, shards: int = 1) -> DataFrame:
    """first, shard, sketch: the devices of each month, by its first day."""
    month = F.to_date(F.date_trunc("month", F.timestamp_millis("ts")))
    seen = history.where("ts IS NOT NULL AND uuid IS NOT NULL").groupBy(month.alias("first"), _shard(F.col("uuid"), shards).alias("shard"))
    return seen.agg(F.theta_sketch_agg("uuid", size).alias("sketch"))


def united(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    if "shard" not in sketches.columns:  # kept before there were shards
        sketches = sketches.withColumn("shard", F.lit(0))
    return sketches.groupBy("first", "shard").agg(F.theta_union_agg("sketch", size).alias("sketch"))


def add_reports(history: DataFrame, folder: str, number: int, size: int = SIZE, shards: int = 1) -> bool:
    """Keep the sketches of batch ``number``, whose numbers rise; False if it was kept before. ``size`` and ``shards`` hold from the first batch on."""
    spark = history.sparkSession
    after, state = last_commit(spark, folder)
    if state.get("batch", -1) >= number:
        return False
    if state:
        size, shards = state.get("size", size), state.get("shards", 1)
    rows, path = month_sketches(history, size, shards), new_path(folder)
    rows.write.parquet(path)
    table = state.get("sketches") or described(rows.schema, [])
    commit(spark, folder, {"batch": number, "size": size, "shards": shards, "sketches": grown(spark, folder, table, path, lambda x: united(x, size))}, after)
    clean(spark, folder)
    return True


def kept_sketches(spark: SparkSession, folder: str) -> DataFrame:
    _, state = last_commit(spark, folder)
    return united(opened(spark, state.get("sketches")), state.get("size", SIZE))


def approx_unique_by_month(sketches: DataFrame, current: DataFrame, as_of: int, months: int = MONTHS, size: int = SIZE, shards: int = 1) -> DataFrame:
    """population, pos, month, devices, as ``unique_by_month`` has them, from sketches by month and ``current`` (uuid, is_docker).

    ``size`` and ``shards``: those of ``sketches``.
    """
    docker = current.where("is_docker AND uuid IS NOT NULL").groupBy(_shard(F.col("uuid"), shards).alias("shard")).agg(F.theta_sketch_agg("uuid", size).alias("docker"))
    rows = sketches.where(F.col("first") >= first_month(as_of, months - 1)).join(docker, "shard", "left")
    without = F.when(F.col("docker").isNull(), F.col("sketch")).otherwise(F.theta_difference("sketch", "docker"))
    each = F.array(*(F.struct(F.lit(p).alias("population"), F.theta_sketch_estimate(c).alias("n")) for p, c in (("all", F.col("sketch")), ("noDocker", without))))
    counted = rows.select("first", F.explode(each).alias("e")).groupBy("first", "e.population").agg(F.sum("e.n").cast("long").alias("devices"))
    return zero_filled(counted, as_of, months)
