"""Readers of landed reports: one JSON file per upload, or Parquet history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .commits import read_table, replace_tables
from .schema import parse_report


def scan_current(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed reports of every ``current.json`` below ``folder``; unreadable ones are left out (see ``scan_broken``)."""
    return _files(spark, folder).where("report.uuid IS NOT NULL OR from_json(value, 'map<string,string>') IS NOT NULL").select("report.*")


def scan_broken(spark: SparkSession, folder: str) -> DataFrame:
    """path and value of the files that aren't JSON objects."""
    return _files(spark, folder).where("from_json(value, 'map<string,string>') IS NULL").select("path", "value")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*current.json").text(folder, wholetext=True)
    return lines.select(F.col("_metadata.file_path").alias("path"), "value", parse_report(F.col("value")).alias("report"))


def history_scan(spark: SparkSession, folder: str) -> DataFrame:
    """uuid and ts of every upload, from file names alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    found = files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("uuid"), F.regexp_extract("path", r"/([0-9]+)\.json", 1).alias("ts"))
    return found.where("ts != ''").withColumn("ts", F.col("ts").cast("long"))


def latest_report(history: DataFrame, device: str = "uuid", time: str = "ts", tie: str = "report_id") -> DataFrame:
    """The last report of each device; of equal times that with the largest ``tie``."""
    order = Window.partitionBy(device).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return history.withColumn("_last", F.row_number().over(order)).where("_last = 1").drop("_last")


def export_archive(history: DataFrame, folder: str) -> None:
    """All reports as gzip JSON files, by month, several files to a month, in the place of the archive in ``folder``; a reader sees one or the other."""
    month = F.date_format(F.timestamp_millis("ts"), "yyyy-MM")
    rows = history.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("uuid"), F.lit(16)))
    replace_tables(history.sparkSession, folder, {"archive": rows}, "json", ("month",), compression="gzip")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "archive")
