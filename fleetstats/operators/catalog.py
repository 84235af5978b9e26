"""The repository catalogue: branches with their head commits, commits not known yet, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import commit, described, grown, last_commit, new_path, opened, read_table, replace_tables

#: Columns of a release that its summary leaves out.
RELEASE_DROPPED = ("assets_url", "upload_url", "assets", "tarball_url", "zipball_url", "author")


def branch_details(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """Branches with message, date and epoch of their head commit, newest first; nulls for an unknown commit."""
    heads = commits.select("sha", "url", F.col("commit.message").alias("message"), F.col("commit.author.date").alias("date"))
    out = branches.select("name", "protected", F.col("commit.sha").alias("sha")).join(heads, "sha", "left")
    return out.withColumn("date_epoch", F.unix_seconds(F.to_timestamp("date"))).orderBy(F.desc_nulls_last("date_epoch"), "name")


def missing_commits(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """Head commits of branches that ``commits`` doesn't have."""
    return branches.select(F.col("commit.sha").alias("sha")).distinct().join(commits.select("sha"), "sha", "left_anti")


def release_summary(releases: DataFrame) -> DataFrame:
    """Releases with the number of their assets instead of links and authors."""
    return releases.withColumn("asset_cnt", F.size("assets")).drop(*RELEASE_DROPPED)


def read_pages(spark: SparkSession, folder: str, schema: str, key: str, page: str = r"([0-9]+)\.json$") -> DataFrame:
    """The rows of a list that has landed as pages, each file a JSON array: columns of ``schema`` (DDL) and place, their order in the whole list.

    The list may have moved between two pages, so of rows with one ``key`` the first stays. ``page``: finds the number in a file's path. A file
    that holds no such array is an error, as the list would have a hole.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), page, 1).cast("long").alias("page"))
    rows = F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    checked = files.withColumn("rows", F.when(F.col("page").isNull() | ~F.trim("value").startswith("["), F.raise_error(F.lit("a page is no JSON array, or has no number"))).otherwise(rows))
    placed = checked.select("page", F.posexplode("rows").alias("pos", "r")).select("r.*", F.struct("page", "pos").alias("place"))
    first = Window.partitionBy(key).orderBy("place")
    return placed.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def merge_commits(spark: SparkSession, folder: str, landed: DataFrame) -> int:
    """Add to the cache in ``folder`` those of ``landed`` whose sha it doesn't have, each once; how many these were."""
    after, state = last_commit(spark, folder)
    new = landed.withColumn("_first", F.row_number().over(Window.partitionBy("sha").orderBy("url"))).where("_first = 1 AND sha IS NOT NULL").drop("_first")
    if "commits" in state:
        new = new.join(opened(spark, state["commits"]).select("sha"), "sha", "left_anti").select(*landed.columns)
    path = new_path(folder)
    new.write.parquet(path)
    added = spark.read.schema(new.schema).parquet(path).count()
    if added:
        commit(spark, folder, {"commits": grown(spark, folder, state.get("commits") or described(landed.schema, []), path)}, after)
    return added


def cached_commits(spark: SparkSession, folder: str) -> DataFrame:
    return opened(spark, last_commit(spark, folder)[1].get("commits"))


def write_catalogue(details: DataFrame, releases: DataFrame, folder: str, last_updated: str) -> None:
    """Branches (from ``branch_details``) and releases (from ``release_summary``) with the time of the update, in the place of what is there, both at once."""
    tables = {name: rows.withColumn("last_updated", F.lit(last_updated)) for name, rows in (("branches", details), ("releases", releases))}
    replace_tables(details.sparkSession, folder, tables)


def read_catalogue(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Branches, newest head first, and releases of the last update."""
    return read_table(spark, folder, "branches").orderBy(F.desc_nulls_last("date_epoch"), "name"), read_table(spark, folder, "releases")
