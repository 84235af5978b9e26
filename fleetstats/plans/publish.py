"""The published documents: one JSON object for each statistic, nested by series and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ages import WINDOWS
from ..operators.registry import HISTORY_STATS, STATS
from ..sources.commits import read_table, replace_tables
from .engine import summary_population

#: The fields of statistics with named series, and the names of the lists that hold the order of their labels.
FIELDS: dict[str, list[tuple[str, str, str | None]]] = {
    "lastReported": [("", "data", "order")],
    "deviceMemory": [("", "memory", "memoryOrder")],
    "deviceStorage": [("storage", "storage", "storageOrder"), ("usedStorage", "usedStorage", "usedStorageOrder")],
    "multisyncPeers": [("", "peers", "peerOrder")],
    "outputLocalPixels": [("", "pixels", "pixelOrder")],
    "outputUniverses": [("universe", "universe", "universeOrder"), ("channel", "channel", "channelOrder")],
    "inputUniverses": [("universe", "universe", "universeOrder"), ("channel", "channel", "channelOrder")],
    "outputPanels": [
        ("panels", "panels", "panelOrder"), ("panelType", "panelType", None), ("panelSubType", "panelSubType", None), ("panelSize", "panelSize", None), ("channel", "channel", "channelOrder"),
    ],
    "topPlugins": [(w, w, None) for w in WINDOWS],
}
POPULATIONS = ("all", "noDocker")
#: A document has about so many keys at most; statistics with more are several documents, told apart by ``part``.
KEYS = 10_000


def quoted(c: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _joined(entries: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(entries)), ",")


def _spine(spark) -> DataFrame:
    """population, stat, field, orders of all statistics; fields that the statistic always has are rows of their own. A few dozen rows."""
    out = []
    for stat in STATS.values():
        fields = FIELDS.get(stat.name, [("", None, None)])
        orders = {series: order for series, _, order in fields if order}
        lists = ",".join(f'"{order}":[' + ",".join(f'"{x}"' for x in stat.orders[series]) + "]" for series, order in orders.items())
        out += [(p, stat.name, field, lists) for p in POPULATIONS for _, field, _ in fields]
    return spark.createDataFrame(out, "population string, stat string, field string, orders string")


def _described(spark) -> DataFrame:
    return spark.createDataFrame([(s.name, s.description) for s in (*STATS.values(), *HISTORY_STATS.values())], "stat string, description string")


def summary_json(summary: DataFrame, histories: DataFrame, as_of: int, keys: int = KEYS) -> DataFrame:
    """population, stat, part, document: a JSON object with ts, description and data for each statistic, even one that counts nothing.

    Data are counts by key, by series and key, or by window and plugin, with the lists of labels in order. ``histories``: of ``history_summary``; they
    have their labels in order.
    A statistic of more than ``keys`` keys has several parts, by a hash of series and key, each with all its fixed fields; together they are the statistic.
    """
    spark = summary.sparkSession
    fixed = F.broadcast(spark.createDataFrame([(stat, series, field) for stat, fields in FIELDS.items() for series, field, _ in fields], "stat string, series string, field string"))
    counts = F.to_json(F.struct(*WINDOWS))
    plain = summary.where("stat != 'topPlugins'").join(fixed, ["stat", "series"], "left")
    plain = plain.select("population", "stat", "series", "key", F.coalesce("field", F.when(F.col("series") != "", F.col("series"))).alias("field"), counts.alias("value"))
    plugins = summary.where("stat = 'topPlugins'").unpivot(["population", "stat", "series", "key"], list(WINDOWS), "field", "n").where("n > 0")
    entries = plain.unionByName(plugins.select("population", "stat", "series", "key", "field", F.col("n").cast("string").alias("value")))

    parts = summary.groupBy("population", "stat").agg(F.ceil(F.count(F.lit(1)) / keys).cast("int").alias("parts"))
    named = F.conv(F.substring(F.md5(F.concat_ws("/", "series", "key")), 1, 7), 16, 10).cast("long")
    entries = entries.join(F.broadcast(parts), ["population", "stat"]).withColumn("part", (named % F.col("parts")).cast("int"))
    entry = F.when(F.col("stat") == "Instances", F.col("value")).otherwise(F.concat(quoted(F.col("key")), F.lit(":"), "value"))
    entries = entries.select("population", "stat", "part", "field", entry.alias("entry"))

    # Every part of a statistic has all fields that the statistic always has.
    spine = F.broadcast(_spine(spark))
    always = spine.join(F.broadcast(parts), ["population", "stat"], "left").select("population", "stat", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "field", F.lit(None).cast("string").alias("entry"))
    inner = F.concat(F.lit("{"), _joined(F.col("entry")), F.lit("}"))
    fields = entries.unionByName(always).groupBy("population", "stat", "part", "field").agg(inner.alias("inner"))
    told = F.when(
        F.col("stat") == "platformVariantBreakout",
        F.concat(F.lit('{"data":'), "inner", F.lit(',"description":'), quoted(F.concat(F.lit("Platform Variant for "), "field")), F.lit("}")),
    ).otherwise(F.col("inner"))
    # A statistic without fields is its entries; Instances' only entry is the object itself.
    bare = F.expr("substr(inner, 2, length(inner) - 2)")
    body = F.when(F.col("field").isNull(), bare).otherwise(F.concat(quoted(F.col("field")), F.lit(":"), told))
    data = fields.select("population", "stat", "part", F.nullif(body, F.lit("")).alias("body")).groupBy("population", "stat", "part").agg(_joined(F.col("body")).alias("body"))
    orders = F.broadcast(spine.select("stat", "orders").distinct())
    whole = F.concat(F.lit("{"), F.concat_ws(",", F.nullif("body", F.lit("")), F.nullif("orders", F.lit(""))), F.lit("}"))
    one = F.when((F.col("stat") == "Instances") & (F.col("body") != ""), F.col("body")).otherwise(whole)
    documents = data.join(orders, "stat").select("population", "stat", "part", one.alias("data"))

    by_place = histories.groupBy("population", "stat").agg(F.sort_array(F.collect_list(F.struct("pos", "label", "n"))).alias("m"))  # a few rows each
    listed = F.concat(
        F.lit('{"data":{'), F.array_join(F.transform("m", lambda x: F.concat(quoted(x["label"]), F.lit(":"), x["n"].cast("string"))), ","),
        F.lit('},"order":['), F.array_join(F.transform("m", lambda x: quoted(x["label"])), ","), F.lit("]}"),
    )
    documents = documents.unionByName(by_place.select("population", "stat", F.lit(0).alias("part"), listed.alias("data")))
    document = F.concat(F.lit(f'{{"ts":{as_of},"description":'), quoted(F.col("description")), F.lit(',"data":'), "data", F.lit("}"))
    return documents.join(F.broadcast(_described(spark)), "stat").select("population", "stat", "part", document.alias("document"))


def write_summary(summary: DataFrame, folder: str) -> None:
    """Put the summary in the place of the one in ``folder``; a reader sees one or the other."""
    replace_tables(summary.sparkSession, folder, {"summary": summary}, partition_by=("population",))


def read_summary(spark: SparkSession, folder: str, docker: str | None = None) -> DataFrame:
    """The rows of one population, chosen as ``engine.summary_population`` does."""
    return summary_population(read_table(spark, folder, "summary"), docker)
