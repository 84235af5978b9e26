"""Statistics of the whole history, and gaps between reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import HistoryStat, register

MONTHS = 15


def with_populations(df: DataFrame, docker: str = "is_docker") -> DataFrame:
    """Each row once for the population of all, and again for that without Docker unless ``docker`` is true."""
    return df.withColumn("population", F.explode(F.when(F.col(docker), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("noDocker")))))


def first_month(as_of: int, months: int = MONTHS) -> Column:
    """The start of the oldest month that counts."""
    return F.add_months(F.date_trunc("month", F.timestamp_millis(F.lit(as_of))), -months)


def unique_by_month(history: DataFrame, current: DataFrame, as_of: int, months: int = MONTHS) -> DataFrame:
    """population, pos, month, devices: devices with a report in each of the last months, newest first, zero filled.

    Whether a device counts is decided by its latest report, in ``current`` (uuid, is_docker). A ``history`` laid out by ``month`` is read only for the
    months that count.
    """
    start = F.unix_millis(first_month(as_of, months).cast("timestamp"))
    seen = history.where(F.col("month") >= first_month(as_of, months - 1)) if dict(history.dtypes).get("month") == "date" else history
    seen = seen.select("uuid", F.col("ts")).where(F.col("ts") > start)
    return months_of(seen.select("uuid", F.date_trunc("month", F.timestamp_millis("ts")).cast("date").alias("first")).distinct(), current, as_of, months)


def months_of(seen: DataFrame, current: DataFrame, as_of: int, months: int = MONTHS) -> DataFrame:
    """``unique_by_month`` of distinct (uuid, first): the months of each device, by their first days."""
    counted = with_populations(seen.join(current.select("uuid", "is_docker"), "uuid")).groupBy("population", "first").agg(F.count(F.lit(1)).alias("devices"))
    return zero_filled(counted, as_of, months)


def zero_filled(counted: DataFrame, as_of: int, months: int = MONTHS) -> DataFrame:
    """population, pos, month, devices of the last months, newest first, from counts (population, first, devices)."""
    spark = counted.sparkSession
    first = F.date_trunc("month", F.timestamp_millis(F.lit(as_of)))
    spine = spark.range(months).select(F.col("id").cast("int").alias("pos"), F.add_months(first.cast("date"), -F.col("id").cast("int")).alias("first"))
    spine = spine.crossJoin(spark.createDataFrame([("all",), ("noDocker",)], "population string"))  # 2 x months rows
    out = F.broadcast(spine).join(counted, ["population", "first"], "left")
    return out.select("population", "pos", F.date_format("first", "MMM-yyyy").alias("month"), F.coalesce("devices", F.lit(0)).alias("devices"))


def _unique_by_month(history: DataFrame, current: DataFrame, as_of: int) -> DataFrame:
    return unique_by_month(history, current, as_of).select("population", "pos", F.col("month").alias("label"), F.col("devices").alias("n"))


register(HistoryStat("uniqueByMonth", "Devices that report in each month", _unique_by_month))


def interarrival(history: DataFrame, device: str = "uuid", time: str = "ts") -> DataFrame:
    """Seconds since the device's last earlier report (one of the same time isn't), and their label: minutes over 120 s, hours over 120 min, days over 48 of either.

    The last rule also takes minutes between 48 and 120, by 24.
    """
    earlier = Window.partitionBy(device).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    gap = (F.col(time) - F.max(time).over(earlier)) / 1000
    seconds = history.withColumn("gap_seconds", gap)
    minutes, hours = F.col("gap_seconds") / 60, F.col("gap_seconds") / 3600
    value = F.when(F.col("gap_seconds") <= 120, F.col("gap_seconds")).when(minutes <= 48, minutes).when(minutes <= 120, minutes / 24).when(hours <= 48, hours).otherwise(hours / 24)
    unit = F.when(F.col("gap_seconds") <= 120, "Seconds Ago").when(minutes <= 48, "Minutes Ago").when(minutes <= 120, "Days Ago").when(hours <= 48, "Hours Ago").otherwise("Days Ago")
    label = F.when(F.col("gap_seconds").isNull(), "First Record").otherwise(F.concat(F.floor(value + 0.5).cast("string"), F.lit(" "), unit))
    return seconds.withColumn("label_ref", label)
