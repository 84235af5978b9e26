"""View queries over the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ages import DEFAULT_WINDOW, WINDOWS
from ..operators.registry import STATS


def period(name: str) -> str:
    """The counter to show: an unknown name means the default."""
    return name if name in WINDOWS else DEFAULT_WINDOW


def of(summary: DataFrame, stat: str, time: str = DEFAULT_WINDOW, population: str = "all", series: str = "") -> DataFrame:
    """label and n of one statistic's series."""
    rows = summary.where((F.col("population") == population) & (F.col("stat") == stat) & (F.col("series") == series))
    return rows.select(F.col("key").alias("label"), F.col(period(time)).alias("n"))


def pie_view(view: DataFrame) -> DataFrame:
    return view.orderBy(F.desc("n"), "label")


def topk_view(view: DataFrame, k: int) -> DataFrame:
    return view.orderBy(F.desc("n"), "label").limit(k)


def percent(n: Column, total: Column) -> Column:
    """One decimal, half up, from integers."""
    return F.when(total > 0, F.floor((n * 2000 + total) / (total * 2)) / 10.0)


def table_pct(view: DataFrame, max_rows: int) -> DataFrame:
    """label, n, pct of the total over all rows; prints one row fewer than ``max_rows``."""
    total = F.broadcast(view.agg(F.sum("n").alias("_total")))  # one row, summed before anything meets
    named = view.withColumn("label", F.when(F.col("label") == "", "Unknown").otherwise(F.col("label")))
    shown = named.orderBy(F.desc("n"), "label").limit(max_rows - 1)
    return shown.join(total).withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total").orderBy(F.desc("n"), "label")


def stat_order(spark: SparkSession, stat: str, series: str = "", without: tuple[str, ...] = ()) -> DataFrame:
    """pos and label of a statistic's fixed labels."""
    labels = [x for x in STATS[stat].orders[series] if x not in without]
    return spark.createDataFrame(list(enumerate(labels)), "pos int, label string")


def dense_bar(view: DataFrame, order: DataFrame) -> DataFrame:
    """All labels of ``order`` (a short list), zero where nothing was counted."""
    return F.broadcast(order).join(view, "label", "left").select("pos", "label", F.coalesce("n", F.lit(0)).alias("n")).orderBy("pos")


def zone_place(label: Column) -> Column:
    """Signed hours and minutes; what has none, then 'Not Reported', last."""
    digits = F.regexp_extract(label, r"^.([0-9]{1,5})", 1)
    n = F.when(digits != "", digits.cast("int"))
    place = F.when(label == "Not Reported", 99_999_999).when(F.substring(label, 1, 1) == "+", n).otherwise(-n)
    return F.coalesce(place, F.lit(99_999_998))


def timezone_order(view: DataFrame) -> DataFrame:
    return view.withColumn("place", zone_place(F.col("label"))).orderBy("place", "label")


def period_options(summary: DataFrame, population: str = "all") -> DataFrame:
    """Each window with its option text."""
    row = summary.where((F.col("stat") == "Instances") & (F.col("population") == population)).select(*WINDOWS)
    return row.unpivot([], list(WINDOWS), "period", "n").withColumn("text", F.concat("period", F.lit(" - "), F.col("n").cast("string"), F.lit("  devices")))


def freshness(df: DataFrame, time_ms: str, as_of: int, limit_s: int = 500) -> DataFrame:
    """last_ms, age_s and OK, or WARNING where the newest row is older than the limit."""
    last = df.agg(F.max(time_ms).alias("last_ms")).withColumn("age_s", F.floor((F.lit(as_of) - F.col("last_ms")) / 1000))
    return last.withColumn("status", F.when(F.col("age_s") > limit_s, "WARNING").otherwise("OK"))


def format_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


#: Kind, statistic, series, most rows and labels left out of the views.
DASHBOARD: dict[str, tuple[str, str, str, int | None, tuple[str, ...]]] = {
    "lastReportDays": ("dense", "lastReported", "", None, ()),
    "memory": ("dense", "deviceMemory", "", None, ()),
    "storage": ("dense", "deviceStorage", "storage", None, ()),
    "usedStorage": ("dense", "deviceStorage", "usedStorage", None, ()),
    "peers": ("dense", "multisyncPeers", "", None, ()),
    "outUniverse": ("dense", "outputUniverses", "universe", None, ()),
    "outChannel": ("dense", "outputUniverses", "channel", None, ()),
    "inUniverse": ("dense", "inputUniverses", "universe", None, ()),
    "inChannel": ("dense", "inputUniverses", "channel", None, ()),
    "localPixels": ("dense", "outputLocalPixels", "", None, ("Zero",)),
    "panelChannel": ("dense", "outputPanels", "channel", None, ("Zero",)),
    "panelCounts": ("dense", "outputPanels", "panels", None, ("Zero",)),
    "timezones": ("zones", "timeZone", "", None, ()),
    "platforms": ("table", "platform", "", 49, ()),
    "genericVariants": ("table", "platformVariantBreakout", "Generic", 49, ()),
    "piVariants": ("table", "platformVariantBreakout", "Raspberry Pi", 49, ()),
    "beagleVariants": ("table", "platformVariantBreakout", "BeagleBone", 49, ()),
    "otherOutputs": ("table", "outputOther", "", 49, ()),
    "versionDetail": ("table", "versionDetailed", "", 49, ()),
    "allPlugins": ("table", "topPlugins", "", 1999, ()),
    "allCapes": ("table", "capeType", "", 1999, ()),
    "modes": ("pie", "fppMode", "", None, ()),
    "versions": ("pie", "version", "", None, ()),
    "mqtt": ("pie", "mqttEnabled", "", None, ()),
    "uiLevels": ("pie", "uiLevel", "", None, ()),
    "capes": ("pie", "capeInstalled", "", None, ()),
    "panelSubType": ("pie", "outputPanels", "panelSubType", None, ()),
    "panelSize": ("pie", "outputPanels", "panelSize", None, ()),
    "releases": ("topk", "versionWithOS", "", 15, ()),
    "topCapes": ("topk", "capeType", "", 15, ()),
    "plugins": ("topk", "topPlugins", "", 10, ()),
    "processors": ("topk", "outputProcessors", "", 10, ()),
    "popularSettings": ("topk", "settingsPopular", "", 12, ()),
}


#: Statistics of the history are shown under their names, or these.
HISTORY_VIEWS = {"uniqueByMonth": "months"}


def dashboard(summary: DataFrame, histories: DataFrame, time: str = DEFAULT_WINDOW, population: str = "all") -> DataFrame:
    """view, kind, pos, label, n and, in tables, pct: all views of one window and population, and the bars of ``histories`` (of ``history_summary``)."""
    spark = summary.sparkSession
    listed = [(view, kind, stat, series, most) for view, (kind, stat, series, most, _) in DASHBOARD.items()]
    asked = F.broadcast(spark.createDataFrame(listed, "view string, kind string, stat string, series string, most int"))
    rows = summary.where(F.col("population") == population).join(asked, ["stat", "series"])
    label = F.when((F.col("kind") == "table") & (F.col("key") == ""), "Unknown").otherwise(F.col("key"))
    rows = rows.select("stat", "view", "kind", "most", label.alias("label"), F.col(period(time)).alias("n")).where("stat != 'topPlugins' OR n > 0")
    ranked = rows.where("kind != 'dense'").withColumn("place", F.when(F.col("kind") == "zones", zone_place(F.col("label"))).otherwise(-F.col("n")))
    ranked = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("view").orderBy("place", "label")) - 1).where("most IS NULL OR pos < most")
    totals = F.broadcast(rows.where("kind = 'table'").groupBy("view").agg(F.sum("n").alias("total")))
    ranked = ranked.join(totals, "view", "left").select("view", "kind", "pos", "label", "n", percent(F.col("n"), F.col("total")).alias("pct"))
    labels = [(view, kind, i, x) for view, (kind, stat, series, _, without) in DASHBOARD.items() if kind == "dense" for i, x in enumerate(x for x in STATS[stat].orders[series] if x not in without)]
    spine = F.broadcast(spark.createDataFrame(labels, "view string, kind string, pos int, label string"))
    bars = spine.join(rows.where("kind = 'dense'").groupBy("view", "label").agg(F.sum("n").alias("n")), ["view", "label"], "left")
    none = F.lit(None).cast("double").alias("pct")
    bars = bars.select("view", "kind", "pos", "label", F.coalesce("n", F.lit(0)).alias("n"), none)
    shown = F.coalesce(F.create_map(*(F.lit(x) for pair in HISTORY_VIEWS.items() for x in pair))[F.col("stat")], F.col("stat"))
    monthly = histories.where(F.col("population") == population).select(shown.alias("view"), F.lit("monthly").alias("kind"), "pos", "label", "n", none)
    return ranked.unionByName(bars).unionByName(monthly)
