"""Reports derived from the driver's orders table: a customer is a device, an order one of its uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing import latest_report

#: 2001-08-02 00:00:00 UTC, later than every report.
AS_OF = 996_710_400_000

#: Flat columns, valid in Spark and DuckDB once EPOCH_MS stands for the engine's expression.
FLAT = """
SELECT k AS report_id, 'dev-' || CAST(c AS STRING) AS uuid, ts,
  CASE k % 7 WHEN 0 THEN 'Raspberry Pi' WHEN 1 THEN 'BeagleBone Black' WHEN 2 THEN 'BeagleBone 64'
    WHEN 3 THEN 'Docker' WHEN 4 THEN 'Debian' WHEN 5 THEN 'Raspberry Pi' END AS platform,
  CASE k % 11 WHEN 0 THEN 'Pi 4' WHEN 1 THEN 'Pi 3' WHEN 2 THEN 'PocketBeagle' WHEN 3 THEN 'Docker'
    WHEN 4 THEN 'PocketBeagle2' WHEN 5 THEN 'Pi 4' WHEN 6 THEN 'Pi 5' WHEN 7 THEN '' WHEN 8 THEN 'Debian' END AS variant,
  CASE k % 13 WHEN 0 THEN '7.5-master-12-gabc' WHEN 1 THEN '7.x-master-3-gdef' WHEN 2 THEN '6.3.2' WHEN 3 THEN '5.5-dirty'
    WHEN 4 THEN '8.0-dirty-x-dirty' WHEN 5 THEN 'master' WHEN 6 THEN 'Unknown' WHEN 7 THEN '9.5' WHEN 8 THEN '7.5'
    WHEN 9 THEN '-odd' WHEN 10 THEN '6.x' WHEN 11 THEN '' END AS version,
  CASE k % 5 WHEN 0 THEN 'v2024-01' WHEN 1 THEN 'v2023-05' WHEN 2 THEN 'v2022-12' END AS os_version,
  CASE k % 6 WHEN 0 THEN 'player' WHEN 1 THEN 'bridge' WHEN 2 THEN 'master' WHEN 3 THEN 'remote' END AS fppd_mode,
  CASE WHEN k % 4 = 0 THEN 'Not Running' ELSE 'running' END AS fppd_status,
  CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS mqtt_configured,
  CASE k % 8 WHEN 0 THEN '+0000 GMT' WHEN 1 THEN '+0000 UTC' WHEN 2 THEN '-0500 EST' WHEN 3 THEN '+0530 IST'
    WHEN 4 THEN '-0800 PST' WHEN 5 THEN '+0100 CET' WHEN 6 THEN '+1000 AEST' END AS timezone,
  CASE k % 9 WHEN 0 THEN 'None' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'PiHat' WHEN 3 THEN 'F16-B' WHEN 4 THEN 'PB16'
    WHEN 5 THEN 'K8-B' WHEN 6 THEN 'PiHat' END AS cape_name,
  CASE k % 10 WHEN 1 THEN 50 WHEN 2 THEN 524288 WHEN 3 THEN 524289 WHEN 4 THEN 1048576 WHEN 5 THEN 2097152
    WHEN 6 THEN 4194304 WHEN 7 THEN 8388608 WHEN 8 THEN 8388609 WHEN 9 THEN 16000000 END AS mem_total,
  CASE WHEN k % 17 <> 0 THEN (k % 300) * 1073741824 + (k % 2) * 524288 END AS media_total,
  CASE WHEN k % 17 <> 0 THEN (k % 300) * 536870912 END AS media_free,
  CASE WHEN k % 19 <> 0 THEN (k * 3) % 120 END AS multisync_n,
  CASE WHEN k % 3 = 0 THEN (k * 37) % 25000 END AS pi_pixels,
  CASE WHEN k % 4 = 1 THEN (k * 41) % 6000 END AS bbb_pixels,
  CASE WHEN k % 5 <> 0 THEN (k * 13) % 600 END AS e131_universes,
  CASE WHEN k % 5 <> 1 THEN (k * 101) % 1200000 END AS e131_channels,
  CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'true' END AS in_enabled,
  (k * 17) % 600 AS in_universes, (k * 103) % 1200000 AS in_channels,
  CASE k % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'false' END AS panel_enabled,
  CASE WHEN k % 7 <> 2 THEN (k * 11) % 80 END AS panel_count,
  CASE WHEN k % 7 <> 3 THEN (k * 107) % 1200000 END AS panel_channels,
  CASE k % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 END AS panel_width,
  CASE k % 2 WHEN 0 THEN 16 WHEN 1 THEN 32 END AS panel_height,
  CASE WHEN k % 11 <> 4 THEN 'LED' END AS panel_type,
  CASE k % 4 WHEN 0 THEN 'LEDscapeMatrix' WHEN 1 THEN 'RGBMatrix' WHEN 2 THEN 'ColorLight' END AS panel_subtype,
  CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS set_multisync,
  CASE k % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' WHEN 5 THEN '' END AS set_ui_level,
  CASE WHEN k % 2 = 0 THEN CAST(k % 101 AS STRING) END AS set_volume,
  CASE WHEN k % 2 = 0 THEN 'alpha' END AS plugin_1, CASE WHEN k % 3 = 0 THEN 'beta' END AS plugin_2,
  CASE WHEN k % 5 = 0 THEN 'gamma' || CAST(k % 23 AS STRING) END AS plugin_3,
  CASE k % 4 WHEN 0 THEN 'DMX' WHEN 1 THEN 'Renard' END AS other_1,
  CASE k % 6 WHEN 0 THEN 'DMX' WHEN 1 THEN 'GenericSerial' END AS other_2,
  CASE WHEN k % 4 < 2 THEN k % 3 END AS remap_active, CASE WHEN k % 5 < 3 THEN k % 4 END AS brightness_active
FROM (SELECT o_orderkey AS k, o_custkey AS c, {EPOCH_MS} + (o_orderkey % 86400) * 1000 AS ts FROM orders) o
"""
SPARK_MS = "unix_micros(cast(o_orderdate AS timestamp)) div 1000"
DUCKDB_MS = "(epoch_us(o_orderdate) // 1000)"


def flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return flat(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def flat(orders: DataFrame) -> DataFrame:
    """The flat reports of orders."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.sparkSession.sql(FLAT.replace("{EPOCH_MS}", SPARK_MS).replace("FROM orders", "FROM {orders}"), orders=orders)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the report_id, uuid and ts of their reports, which say all that is needed to choose the latest; ``of_uploads`` makes the reports."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    ts = F.expr(SPARK_MS) + (F.col("o_orderkey") % 86400) * 1000
    return orders.select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("dev-"), F.col("o_custkey").cast("string")).alias("uuid"), ts.alias("ts"), "*")


def of_uploads(rows: DataFrame) -> DataFrame:
    return nested(flat(rows))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in the nested schema, with ``report_id``."""
    return nested(flat_reports(spark, sf_dir))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each device, chosen before anything else of it is made."""
    return of_uploads(latest_report(uploads(spark, sf_dir)))


def nested(flat: DataFrame) -> DataFrame:
    """Flat reports in the schema of real ones."""
    s = lambda c: F.col(c).cast("string")
    struct = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))

    def mapped(entries):
        kept = F.filter(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in entries)), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
        return F.map_from_entries(kept)

    media = F.when(F.col("media_total").isNotNull(), struct(Total=s("media_total"), Free=s("media_free")))
    return flat.select(
        "report_id",
        "uuid",
        "ts",
        struct(
            platform=s("platform"), platformVariant=s("variant"), version=s("version"), osVersion=s("os_version"), fppdMode=s("fppd_mode"), fppdStatus=s("fppd_status"),
            mqtt=struct(configured=F.try_parse_json("mqtt_configured")), utilization=struct(Disk=struct(Media=media)),
        ).alias("systemInfo"),
        struct(MemTotal=s("mem_total")).alias("memory"),
        F.when(F.col("multisync_n").isNotNull(), F.array_repeat(F.lit("{}"), F.col("multisync_n").cast("int"))).alias("multisync"),
        mapped([(F.lit("MultiSyncEnabled"), s("set_multisync")), (F.lit("uiLevel"), s("set_ui_level")), (F.lit("volume"), s("set_volume")), (F.lit("FPP_UUID"), s("uuid"))]).alias("settings"),
        struct(name=s("cape_name")).alias("capeInfo"),
        "timezone",
        mapped([(F.col(f"plugin_{i}"), F.lit("{}")) for i in (1, 2, 3)]).alias("plugins"),
        mapped([(F.lit("Remap"), F.when(F.col("remap_active").isNotNull(), struct(activeCnt=s("remap_active")))), (F.lit("Brightness"), F.when(F.col("brightness_active").isNotNull(), struct(activeCnt=s("brightness_active"))))]).alias("outputProcessors"),
        struct(types=F.array_compact(F.array("other_1", "other_2"))).alias("output_other"),
        struct(pixelCount=s("pi_pixels")).alias("output_pixel_pi"),
        struct(pixelCount=s("bbb_pixels")).alias("output_pixel_bbb"),
        struct(universeCount=s("e131_universes"), channelCount=s("e131_channels")).alias("output_e131"),
        struct(enabled=s("in_enabled"), universeCount=s("in_universes"), channelCount=s("in_channels")).alias("universe_input"),
        struct(
            enabled=s("panel_enabled"), panelCount=s("panel_count"), channelCount=s("panel_channels"), panelWidth=s("panel_width"), panelHeight=s("panel_height"), type=s("panel_type"), subType=s("panel_subtype"),
        ).alias("output_panel"),
    )
