"""History on laid-out tables, sketches, heavy keys, pages, and statistics of the history from the registry."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetstats import queries
from fleetstats.operators import catalog, heavy, history, registry, sketches
from fleetstats.operators.registry import HISTORY_STATS, STATS, HistoryStat
from fleetstats.plans import engine, publish, views
from fleetstats.sources import commits, demo, layout

AS_OF = demo.AS_OF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def reports(spark, sf_dir):
    return demo.reports(spark, sf_dir)


@pytest.fixture(scope="module")
def current(reports):
    return engine.snapshot(reports, AS_OF).select("uuid", "is_docker").persist()


def test_months_and_buckets_save_reading_and_shuffles(spark, reports, current, tmp_path):
    folder = str(tmp_path / "laid")
    layout.lay_out(folder, {"history": layout.by_month(reports.select("uuid", "ts", "report_id")), "current": current}, buckets=4)
    laid, now = (layout.laid_out(spark, folder, t) for t in ("history", "current"))
    assert rows(laid.select("uuid", "ts", "report_id")) == rows(reports.select("uuid", "ts", "report_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = history.unique_by_month(laid, now, AS_OF)
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The only shuffle is that of the counts by population and month, and of the few rows that they are laid beside.
    assert set(re.findall(r"Exchange hashpartitioning\(([a-z]+)#\d+, ([a-z]+)#", plan)) == {("population", "first")} and plan.count("Exchange") == 2, plan
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 2000-06-01", plan), plan
    assert rows(made) == rows(history.unique_by_month(reports, current, AS_OF))
    layout.lay_out(folder, {"history": layout.by_month(reports.limit(3).select("uuid", "ts", "report_id")), "current": current}, buckets=4)
    assert laid.count() == reports.count() and layout.laid_out(spark, folder, "history").count() == 3


def test_sketches_add_up(spark, reports, current, tmp_path):
    folder = str(tmp_path / "sketches")
    for n in range(5):
        part = reports.where(F.col("report_id") % 5 == n)
        assert sketches.add_reports(part, folder, n) and not sketches.add_reports(part, folder, n)
    got = sketches.approx_unique_by_month(sketches.kept_sketches(spark, folder), current, AS_OF)
    assert rows(got) == rows(history.unique_by_month(reports, current, AS_OF))


def test_error_of_sketches(spark, tmp_path):
    """60,000 devices with sketches of 4,096 entries: within four standard errors of the exact count, in parts and at once."""
    base = AS_OF - 40 * 86_400_000
    seen = spark.range(90_000).select(F.concat(F.lit("d"), F.col("id") % 60_000).alias("uuid"), F.lit(base).alias("ts"))
    now = spark.range(60_000).select(F.concat(F.lit("d"), F.col("id")).alias("uuid"), (F.col("id") % 3 == 0).alias("is_docker"))
    for n in range(2):
        sketches.add_reports(seen.where(F.crc32("uuid") % 2 == n), str(tmp_path), n, size=12)
    got = {r["population"]: r["devices"] for r in sketches.approx_unique_by_month(sketches.kept_sketches(spark, str(tmp_path)), now, AS_OF, size=12).where("devices > 0").collect()}
    want = {r["population"]: r["devices"] for r in history.unique_by_month(seen, now, AS_OF).where("devices > 0").collect()}
    assert want == {"all": 60_000, "noDocker": 40_000}
    assert all(abs(got[p] - want[p]) <= 4 * 60_000 / 64 for p in want) and got != want


def test_the_query_counts_any_number_of_devices(spark, tmp_path):
    """40,000 devices, more than a sketch of the default size holds exactly, each with two reports in one month."""
    pytest.importorskip("duckdb").connect().execute(f"""
        COPY (SELECT i AS o_orderkey, i % 40000 AS o_custkey, TIMESTAMP '2001-06-01' + to_days(CAST(i % 7 AS INTEGER)) AS o_orderdate FROM range(80000) t(i)) TO '{tmp_path}/orders.parquet'""")
    got = queries.approx_unique_by_month(spark, str(tmp_path))
    assert got.where("population = 'all' AND month = 'Jun-2001'").first()["devices"] == 40_000
    assert rows(got) == rows(queries.unique_by_month(spark, str(tmp_path)))


def ranked(pairs, k):
    out = []
    for series in {s for s, _ in pairs if s is not None}:
        counts = Counter(key for s, key in pairs if s == series and key is not None)
        out += [(series, i + 1, key, n) for i, (key, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("counters", [5, 40, 10_000])
def test_heavy_keys_are_exact(spark, counters):
    rng = random.Random(1)
    pairs = [("skewed", f"k{int(rng.paretovariate(0.9))}") for _ in range(3000)] + [("unique", f"u{i}") for i in range(2000)] + [("ties", "abcdefgh"[i % 8]) for i in range(800)] + [("few", "only")] * 50 + [(None, "x"), ("few", None)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "series string, key string").repartition(3)
    assert rows(heavy.top_keys(df, 4, counters)) == sorted(ranked(pairs, 4), key=repr)
    assert heavy.top_keys(df.where("false"), 4, counters).count() == 0


def test_heavy_keys_need_no_count_of_the_others(spark):
    """A series with frequent keys is certain after the candidates' count, though most of its keys got no counter."""
    pairs = [("s", f"hot{i % 3}") for i in range(6000)] + [("s", f"rare{i}") for i in range(3000)]
    df = spark.createDataFrame(pairs, "series string, key string").repartition(2)
    kept = df.mapInArrow(heavy._count(100), heavy._KEPT).collect()
    bound = sum(r["lost"] for r in kept)
    assert len({r["key"] for r in kept if r["key"]}) <= 200 and 0 < bound < 2000
    assert [r["n"] for r in heavy.top_keys(df, 3, 100).collect()] == [2000] * 3


BRANCH = "name string, protected boolean, commit struct<sha:string,url:string>"


def pages(folder, lists):
    folder.mkdir(parents=True)
    for i, names in enumerate(lists, 1):
        (folder / f"branches-{i}.json").write_text(json.dumps([{"name": n, "protected": i == 1, "commit": {"sha": n * 2, "url": ""}, "more": 1} for n in names], indent=1))


def test_pages_are_one_list(spark, tmp_path):
    pages(tmp_path / "p", [["a", "b"], ["b", "c"], *[[x] for x in "defghij"], ["k", "a"], []])
    found = catalog.read_pages(spark, str(tmp_path / "p"), BRANCH, "name").orderBy("place").collect()
    assert [r["name"] for r in found] == list("abcdefghijk") and [r["protected"] for r in found[:3]] == [True, True, False]
    (tmp_path / "p" / "branches-5.json").write_text('[{"name": "e"')
    with pytest.raises(Exception):
        catalog.read_pages(spark, str(tmp_path / "p"), BRANCH, "name").collect()
    (tmp_path / "p" / "branches-5.json").write_text('{"message": "rate limit"}')
    with pytest.raises(Exception, match="JSON array"):
        catalog.read_pages(spark, str(tmp_path / "p"), BRANCH, "name").collect()


def test_commits_are_cached_once(spark, tmp_path):
    schema, folder = "sha string, url string, commit struct<message:string,author:struct<date:string>>", str(tmp_path / "c")

    def landed(*shas):
        return spark.createDataFrame([(s, f"u/{s}", (f"says {s}", ("2024-01-01T00:00:00Z",))) for s in shas], schema)

    assert catalog.merge_commits(spark, folder, landed("a", "b", "b")) == 2
    assert catalog.merge_commits(spark, folder, landed("b", "c")) == 1
    before = commits.last_commit(spark, folder)
    assert catalog.merge_commits(spark, folder, landed("a", "c")) == 0 and commits.last_commit(spark, folder) == before
    assert sorted(r["sha"] for r in catalog.cached_commits(spark, folder).collect()) == ["a", "b", "c"]
    branches = spark.createDataFrame([("x", True, ("c", "")), ("y", True, ("z", ""))], BRANCH)
    assert [r["sha"] for r in catalog.missing_commits(branches, catalog.cached_commits(spark, folder)).collect()] == ["z"]


def test_a_second_history_statistic_is_published(spark, reports, monkeypatch):
    def by_day(seen, now, as_of):
        assert seen.columns == ["uuid", "ts"]
        counted = history.with_populations(seen.join(now.select("uuid", "is_docker"), "uuid")).groupBy("population", F.dayofweek(F.timestamp_millis("ts")).alias("pos")).count()
        return counted.select("population", "pos", F.concat(F.lit("day "), F.col("pos")).alias("label"), F.col("count").alias("n"))

    monkeypatch.setitem(HISTORY_STATS, "reportsByDay", None)
    registry.register(HistoryStat("reportsByDay", "Reports by day of week", by_day))
    snap = engine.snapshot(reports, AS_OF)
    found = engine.history_summary(reports, snap, AS_OF).persist()
    assert {r[0] for r in found.select("stat").distinct().collect()} == {"uniqueByMonth", "reportsByDay"}
    assert found.where("stat = 'reportsByDay' AND population = 'all'").agg(F.sum("n")).first()[0] == reports.count()
    few = engine.summary(snap, [STATS["platform"]])
    docs = {(r["population"], r["stat"]): json.loads(r["document"]) for r in publish.summary_json(few, found, AS_OF).where("stat IN ('reportsByDay', 'uniqueByMonth')").collect()}
    assert len(docs) == 4 and docs["all", "reportsByDay"]["description"] == "Reports by day of week" and docs["all", "reportsByDay"]["data"]["order"][0] == "day 1"
    shown = views.dashboard(few, found).where("kind = 'monthly'")
    assert {r[0] for r in shown.select("view").distinct().collect()} == {"months", "reportsByDay"}


def test_the_summary_is_written_and_read_by_population(spark, reports, tmp_path):
    snap = engine.snapshot(reports, AS_OF)
    whole, folder = engine.summary(snap, [STATS["platform"], STATS["topPlugins"]]).persist(), str(tmp_path)
    publish.write_summary(whole.limit(1), folder)
    publish.write_summary(whole, folder)
    for flag, name in (("FALSE", "noDocker"), ("true", "all"), (None, "all")):
        want = rows(whole.where(F.col("population") == name))
        assert rows(publish.read_summary(spark, folder, flag).select(*whole.columns)) == want
        assert rows(engine.summary_for(snap, flag, [STATS["platform"], STATS["topPlugins"]]).select(*whole.columns)) == want
