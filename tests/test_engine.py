"""Properties of the summary, the user's own statistics, sources, ingest, streams, publication."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetstats.functions.ages import WINDOWS
from fleetstats.operators import catalog, history
from fleetstats.operators.registry import STATS, HISTORY_STATS, Stat
from fleetstats.plans import engine, publish, views
from fleetstats.sources import demo, landing
from fleetstats.sources.schema import parse_report
from fleetstats.sources.shared import stored
from fleetstats.streaming import ingest

AS_OF = demo.AS_OF
COUNTS = list(WINDOWS)


@pytest.fixture(scope="module")
def current(spark, sf_dir):
    return stored(engine.snapshot(demo.reports(spark, sf_dir), AS_OF))


@pytest.fixture(scope="module")
def summary(current):
    return engine.summary(current).persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_windows_are_nested_and_populations_too(summary):
    order = [*COUNTS[1:], COUNTS[0]]
    bad = " OR ".join(f"{a} > {b}" for a, b in zip(order, order[1:]))
    assert summary.where(bad).count() == 0
    a, b = (summary.where(F.col("population") == p) for p in ("all", "noDocker"))
    assert b.alias("b").join(a.alias("a"), ["stat", "series", "key"]).where("b.totalCount > a.totalCount").count() == 0


def test_statistics_that_always_count_add_up(summary):
    total = summary.where("stat = 'Instances' AND population = 'all'").first()["totalCount"]
    for stat in ("platformVariant", "capeInstalled", "fppMode", "mqttEnabled", "uiLevel", "timeZone", "lastReported", "deviceMemory", "multisyncPeers", "outputLocalPixels"):
        assert summary.where((F.col("stat") == stat) & (F.col("population") == "all")).agg(F.sum("totalCount")).first()[0] == total, stat


def test_families_equal_single_statistics(current, summary):
    for name in ("version", "outputPanels", "settingsValues", "topPlugins"):
        assert rows(engine.summary(current, [STATS[name]])) == rows(summary.where(F.col("stat") == name))


def test_generated_methods_stay_compilable(spark, current):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = {}
    try:
        for family in engine.families(list(STATS.values())):
            counted = engine.rows_of(current, family).groupBy("stat", "series", "key", "age_class", "is_docker").count()
            text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(counted._jdf.queryExecution().executedPlan()).toString()
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:\s*(\d+)", text)] or [int(x) for x in re.findall(r"ByteCodeStats\((\d+)", text)]
            found[tuple(s.name for s in family)] = max(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(found.values()) < 8000, found


def test_own_statistic(current):
    own = Stat("osVersion", "OS versions", fixed=lambda: [("", F.col("systemInfo.osVersion"))], drop={"": ("v2022-12",)})
    got = engine.summary(current, [own]).where("population = 'all'")
    want = current.where("systemInfo.osVersion IS NOT NULL AND systemInfo.osVersion != 'v2022-12'").groupBy("systemInfo.osVersion").count()
    assert sorted((r["key"], r["totalCount"]) for r in got.collect()) == sorted(map(tuple, want.collect()))


REPORTS = [
    '{"uuid":"a","ts":1}',
    '{"uuid":"b","ts":996700000000,"systemInfo":{"platform":"Docker","version":"7.5-master-1-g","mqtt":{"configured":"false"}},"settings":{"uiLevel":1.5,"x":1.0},"multisync":[{},{}],"output_other":{"types":["DMX","DMX"]},"timezone":null}',
    '{"uuid":"c","systemInfo":{"platform":"Raspberry Pi","utilization":{"Disk":{"Media":{"Total":4294967296,"Free":0}}}},"output_panel":{"enabled":true,"panelCount":3,"panelWidth":64,"panelHeight":32.0,"subType":"RGBMatrix"}}',
    '{"uuid":"d","ts":996800000000,"systemInfo":[],"settings":[],"plugins":{"p":{}}}',
]


def test_hand_reports(spark):
    parsed = spark.createDataFrame([(r,) for r in REPORTS], "value string").select(parse_report(F.col("value")).alias("r")).select("r.*", F.lit(0).alias("report_id"))
    out = engine.summary(engine.snapshot(parsed, AS_OF)).where("population = 'all'")
    got = {(r["stat"], r["series"], r["key"]): (r["totalCount"], r["last7Days"], r["last365Days"]) for r in out.collect()}
    assert got["Instances", "", ""] == (4, 2, 2)
    assert got["lastReported", "", "> 1 year"] == (2, 1, 1)  # very old, and in the future
    assert got["lastReported", "", "< 24 hrs"] == (2, 1, 1)  # recent, and without a time
    assert got["mqttEnabled", "", "fppd Stopped"][0] == 2 and got["mqttEnabled", "", "Yes"][0] == 1 and got["mqttEnabled", "", "No"][0] == 1
    assert got["uiLevel", "", "undefined"][0] == 1 and got["uiLevel", "", "Basic"][0] == 3
    assert got["timeZone", "", "Not Reported"][0] == 4
    assert got["outputOther", "", "DMX"][0] == 1 and got["settingsValues", "x", "1"][0] == 1
    assert got["deviceStorage", "storage", "4GB"][0] == 1 and got["deviceStorage", "storage", "Unknown"][0] == 3
    assert got["outputPanels", "panelSize", "64x32"][0] == 1 and got["outputPanels", "panelSubType", "RGBMatrix(Pi)"][0] == 1
    assert got["topPlugins", "", "p"] == (1, 1, 1) and got["multisyncPeers", "", "1"][0] == 1


def test_upload_statuses(spark):
    big = '{"uuid":"x","y":"' + "z" * 100_000 + '"}'
    vectors = {"not json": ("Not JSON", ""), "5": ("Not JSON Object", ""), "null": ("Not JSON Object", ""), "[]": ("Invalid Record", ""), "{}": ("Invalid Record", ""), '{"uuid":"a b"}': ("Invalid UUID Format", ""),
               '{"uuid":""}': ("OK", ""), big: ("Payload too large", "x"), '{"uuid":"x","systemInfo":[]}': ("OK", "x"), '{"uuid":"x","settings":[]}': ("OK", "x")}
    got = ingest.upload_status(spark.createDataFrame([(k,) for k in vectors], "value string")).collect()
    assert {r["value"]: (r["status"], r["uuid"]) for r in got} == vectors


def landed(folder: Path):
    for uuid, times in {"a": (1000, 2000), "b": (996_700_000_000,)}.items():
        (folder / uuid).mkdir(parents=True)
        for t in times:
            text = json.dumps({"uuid": uuid, "ts": t, "timezone": "+0000 GMT"})
            (folder / uuid / f"{t}.json").write_text(text)
            (folder / uuid / "current.json").write_text(text)


def test_file_sources(spark, tmp_path):
    landed(tmp_path)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "current.json").write_text("{half")
    assert rows(landing.scan_current(spark, str(tmp_path)).select("uuid", "ts")) == [("a", 2000), ("b", 996_700_000_000)]
    assert landing.scan_broken(spark, str(tmp_path)).count() == 1
    assert rows(landing.history_scan(spark, str(tmp_path))) == [("a", 1000), ("a", 2000), ("b", 996_700_000_000)]


def test_archive_export(spark, sf_dir, tmp_path):
    flat = demo.flat_reports(spark, sf_dir)
    landing.export_archive(flat.limit(10), str(tmp_path / "out"))
    landing.export_archive(flat, str(tmp_path / "out"))
    found = landing.read_archive(spark, str(tmp_path / "out"))
    assert rows(found.select("report_id", "ts", "version")) == rows(flat.select("report_id", "ts", "version"))


def test_published_documents(spark, summary, current, sf_dir):
    months = engine.history_summary(demo.reports(spark, sf_dir), current, AS_OF)

    def published(found, keys=publish.KEYS):
        return {(r["population"], r["stat"], r["part"]): json.loads(r["document"]) for r in publish.summary_json(found, months, AS_OF, keys).collect()}

    docs = published(summary)
    assert len(docs) == 2 * (len(STATS) + 1) and docs["all", "platform", 0]["ts"] == AS_OF
    counts = {(r["stat"], r["series"], r["key"]): {w: r[w] for w in COUNTS} for r in summary.where("population = 'all'").collect()}
    data = {stat: doc["data"] for (population, stat, _), doc in docs.items() if population == "all"}
    assert data["Instances"] == counts["Instances", "", ""]
    assert data["platform"] == {k: v for (stat, _, k), v in counts.items() if stat == "platform"}
    assert data["deviceMemory"]["memory"] == {k: v for (stat, _, k), v in counts.items() if stat == "deviceMemory"} and data["deviceMemory"]["memoryOrder"][-1] == ">8GB"
    assert set(data["outputPanels"]) == {"panels", "panelType", "panelSubType", "panelSize", "channel", "panelOrder", "channelOrder"}
    assert data["platformVariantBreakout"]["Generic"]["description"] == "Platform Variant for Generic"
    assert data["settingsValues"]["volume"] == {k: v for (stat, series, k), v in counts.items() if (stat, series) == ("settingsValues", "volume")}
    assert list(data["topPlugins"]["totalCount"].values()) and set(data["topPlugins"]) == set(COUNTS)
    assert len(data["uniqueByMonth"]["order"]) == 15 and list(data["uniqueByMonth"]["data"]) == data["uniqueByMonth"]["order"]
    some = summary.where("stat IN ('settingsValues', 'deviceMemory')")
    merged = {}
    for (population, stat, _), doc in published(some, 20).items():
        if (population, stat) == ("all", "settingsValues"):
            for series, values in doc["data"].items():
                assert not set(values) & set(merged.setdefault(series, {}))
                merged[series].update(values)
    assert merged == data["settingsValues"]
    none = published(summary.where("false"))
    assert none["all", "deviceMemory", 0]["data"]["memory"] == {} and none["all", "platform", 0]["data"] == {}


def test_catalogue_is_written_and_read(spark, tmp_path):
    branches = spark.createDataFrame([("old", False, ("a", "")), ("new", True, ("b", "")), ("odd", False, ("c", ""))], "name string, protected boolean, commit struct<sha:string,url:string>")
    commits = spark.createDataFrame([("a", "u/a", ("x", ("2024-01-01T00:00:00Z",))), ("b", "u/b", ("y", ("2024-02-01T00:00:00Z",)))], "sha string, url string, commit struct<message:string,author:struct<date:string>>")
    releases = spark.createDataFrame([(1, [1, 2], "z")], "id long, assets array<int>, author string")
    catalog.write_catalogue(catalog.branch_details(branches, commits), catalog.release_summary(releases), str(tmp_path), "2024-03-01T00:00:00Z")
    found, shown = catalog.read_catalogue(spark, str(tmp_path))
    assert [(r["name"], r["last_updated"]) for r in found.collect()] == [(n, "2024-03-01T00:00:00Z") for n in ("new", "old", "odd")]
    assert shown.first().asDict() == {"id": 1, "asset_cnt": 2, "last_updated": "2024-03-01T00:00:00Z"}


def test_views(spark, summary):
    view = views.of(summary, "platformVariant", "nonsense")
    assert rows(view) == rows(views.of(summary, "platformVariant", "last365Days"))
    assert views.topk_view(view, 3).count() == 3 and views.table_pct(view, 3).count() == 2
    dense = views.dense_bar(views.of(summary, "deviceMemory"), views.stat_order(spark, "deviceMemory")).collect()
    assert [r["label"] for r in dense][-1] == ">8GB" and dense[-1]["n"] == 0
    zones = [r["label"] for r in views.timezone_order(views.of(summary, "timeZone", "totalCount")).collect()]
    assert zones[0].startswith("-0800") and zones[-1] == "Not Reported"


def test_gap_labels(spark):
    gaps = [0, 120, 121, 48 * 60, 60 * 60, 121 * 60, 49 * 3600]
    times = [sum(gaps[: i + 1]) * 1000 for i in range(len(gaps))]
    got = history.interarrival(spark.createDataFrame([("d", t) for t in times], "uuid string, ts long")).orderBy("ts").collect()
    assert [r["label_ref"] for r in got] == ["First Record", "120 Seconds Ago", "2 Minutes Ago", "48 Minutes Ago", "3 Days Ago", "2 Hours Ago", "2 Days Ago"]


def test_gaps_of_equal_times(spark):
    got = history.interarrival(spark.createDataFrame([("d", 1000), ("d", 1000), ("d", 6000), ("d", 6000)], "uuid string, ts long")).orderBy("ts").collect()
    assert [r["label_ref"] for r in got] == ["First Record"] * 2 + ["5 Seconds Ago"] * 2


def test_ui_levels_by_hand(spark):
    want = {"0": "Basic", "3": "Developer", "4": "Undefined", "-1": "Undefined", "x": "Undefined", "": "undefined", "true": "undefined", "false": "undefined", "1.0": "undefined", None: "Basic"}
    rows = spark.createDataFrame([({"uiLevel": k} if k is not None else {}, v) for k, v in want.items()], "settings map<string,string>, want string")
    assert all(r["got"] == r["want"] for r in rows.select("want", STATS["uiLevel"].fixed()[0][1].alias("got")).collect())


def test_size_of_the_report_as_written_again(spark):
    blank, old = '{"uuid": "a",' + " " * 100_000 + '"x": 1}', '{"uuid":"a","ts":123456789,"x":"' + "y" * (100_000 - 40) + '"}'
    large = '{"uuid":"a","x":"' + "y" * 100_000 + '"}'
    rows = spark.createDataFrame([(1, blank), (2, old), (3, large)], "i int, value string")
    assert [r["status"] for r in ingest.upload_status(rows, "value", 1).orderBy("i").collect()] == ["OK", "OK", "Payload too large"]


def test_history_statistic_is_registered():
    assert "uniqueByMonth" in HISTORY_STATS


def test_empty_tables(spark, sf_dir):
    none = demo.reports(spark, sf_dir).where("false")
    snap = engine.snapshot(none, AS_OF)
    assert engine.summary(snap).count() == 0
    assert history.unique_by_month(none, snap, AS_OF).agg(F.sum("devices")).first()[0] == 0
    releases = spark.createDataFrame([], "id long, assets array<int>, author string")
    assert catalog.release_summary(releases).columns == ["id", "asset_cnt"]
