"""Commits, ingest of bodies, and what is kept batch by batch, over several batches with default parameters."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetstats import queries
from fleetstats.operators import history
from fleetstats.operators.registry import STATS
from fleetstats.plans import engine
from fleetstats.sources import commits, demo
from fleetstats.sources.schema import parse_report
from fleetstats.streaming import ingest, state

AS_OF = demo.AS_OF
HOUR = state.GRAIN_MS


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_reader_sees_the_old_state_until_the_commit(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    commits.replace_tables(spark, folder, {"a": spark.range(3), "b": spark.range(5)})
    before = commits.read_table(spark, folder, "a")

    def stopped(*_):
        assert commits.read_table(spark, folder, "a").count() == 3  # all data are written, nothing is named
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", stopped)
        with pytest.raises(RuntimeError):
            commits.replace_tables(spark, folder, {"a": spark.range(7), "b": spark.range(7)})
    assert commits.read_table(spark, folder, "a").count() == 3
    commits.replace_tables(spark, folder, {"a": spark.range(7), "b": spark.range(8)})
    assert before.count() == 3 and commits.read_table(spark, folder, "a").count() == 7 and commits.read_table(spark, folder, "b").count() == 8
    commits.replace_tables(spark, folder, {"a": spark.range(0), "b": spark.range(0)})
    commits.replace_tables(spark, folder, {"a": spark.range(0), "b": spark.range(1)})
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4 and commits.read_table(spark, folder, "a").count() == 0


def test_of_two_writers_one_has_to_start_again(spark, tmp_path):
    folder = str(tmp_path)
    after, _ = commits.last_commit(spark, folder)
    commits.commit(spark, folder, {"x": 1}, after)
    with pytest.raises(Exception, match="(?i)exist"):
        commits.commit(spark, folder, {"x": 2}, after)
    assert commits.last_commit(spark, folder) == (0, {"x": 1})


def body(uuid, **more):
    return json.dumps({"uuid": uuid, "systemInfo": {"platform": "Raspberry Pi", "version": "7.5"}, "settings": {"volume": 3}, **more}, indent=2)


def test_bodies_are_whole_files(spark, tmp_path):
    land, folder, kept, check = (str(tmp_path / x) for x in ("land", "folder", "kept", "check"))
    Path(land).mkdir()
    large = body("big", x="y" * 3_000_000)
    for i, text in enumerate([body("a"), body("b"), "not\njson", large, "[\n]", '{\n"uuid": "a b"}']):
        (Path(land) / f"{i}.json").write_text(text)
    ingest.stream_ingest(spark, land, folder, check, 5_000, kept=kept, files=2).awaitTermination()
    assert {r["uuid"] for r in ingest.read_history(spark, folder).collect()} == {"a", "b"}
    assert sorted(r["status"] for r in ingest.read_rejected(spark, folder).collect()) == ["Invalid Record", "Invalid UUID Format", "Not JSON", "Payload too large"]
    (Path(land) / "7.json").write_text(body("a", timezone="+0100 CET"))
    ingest.stream_ingest(spark, land, folder, check, 5_000, kept=kept).awaitTermination()
    assert ingest.read_history(spark, folder).count() == 3
    latest = {r["uuid"]: (r["ts"], r["timezone"]) for r in state.current_reports(spark, kept).collect()}
    assert latest == {r["uuid"]: (r["ts"], r["timezone"]) for r in ingest.stream_latest(spark, folder).collect()} and latest["a"][1] == "+0100 CET"
    assert rows(state.summary(spark, kept, HOUR)) == rows(engine.summary(engine.aged(ingest.stream_latest(spark, folder), HOUR)))


def test_lines_are_bodies_too(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "1.txt").write_text('{"uuid":"a"}\n{"uuid":"b"}\nnot json')
    ingest.stream_ingest(spark, str(land), str(tmp_path / "f"), str(tmp_path / "c"), 0, lines=True).awaitTermination()
    assert ingest.read_history(spark, str(tmp_path / "f")).count() == 2 and ingest.read_rejected(spark, str(tmp_path / "f")).count() == 1


@pytest.mark.parametrize("at", ["history", "kept"])
def test_a_stopped_batch_is_never_read_and_comes_again(spark, tmp_path, monkeypatch, at):
    land, folder, kept, check = (str(tmp_path / x) for x in ("land", "folder", "kept", "check"))
    Path(land).mkdir()
    (Path(land) / "0.json").write_text(body("a"))
    ingest.stream_ingest(spark, land, folder, check, 0, kept=kept).awaitTermination()
    (Path(land) / "1.json").write_text(body("b"))
    (Path(land) / "2.json").write_text("broken")

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ingest if at == "history" else state, "commit", stopped)
        with pytest.raises(Exception, match="stopped"):
            ingest.stream_ingest(spark, land, folder, check, 0, kept=kept).awaitTermination()
    assert ingest.read_history(spark, folder).count() == (1 if at == "history" else 2) and state.current_reports(spark, kept).count() == 1
    assert ingest.read_rejected(spark, folder).count() == (0 if at == "history" else 1) if at == "kept" else True
    ingest.stream_ingest(spark, land, folder, check, 0, kept=kept).awaitTermination()
    assert ingest.read_history(spark, folder).count() == 2 and ingest.read_rejected(spark, folder).count() == 1
    assert state.current_reports(spark, kept).count() == 2 and state.summary(spark, kept, 0, [STATS["Instances"]]).where("population = 'all'").first()["totalCount"] == 2


def random_batches(n=5):
    """Reports of few devices with late, equal, repeated and missing times, some at the very bounds of windows."""
    rng = random.Random(11)
    edges = [AS_OF - d * 86_400_000 + e for d in (0, 1, 7, 30, 365) for e in (-1, 0, 1)]
    out = []
    for _ in range(n):
        batch = []
        for _ in range(30):
            doc = {"uuid": f"d{rng.randrange(25)}", "systemInfo": {"platform": rng.choice(["Docker", "Raspberry Pi", "BeagleBone 64"]), "version": rng.choice(["7.5", "8.1-dirty"])}, "plugins": {rng.choice("pq"): {}}, "settings": {"volume": rng.randrange(3)}}
            batch.append((rng.choice([None, *edges, *(AS_OF - rng.randrange(40) * 5_000_000 for _ in range(9))]), rng.randrange(4), json.dumps(doc)))
        out.append(batch + batch[:2])
    return out + [out[0]]


def parsed(spark, batch):
    raw = spark.createDataFrame(batch, "ts long, report_id long, value string").withColumn("r", parse_report(F.col("value")))
    return raw.select("r.uuid", "ts", "report_id", *[f"r.{f}" for f in ingest.parse_fields() if f not in ("uuid", "ts")])


def test_the_summary_follows_every_batch(spark, tmp_path):
    folder, so_far = str(tmp_path), []
    chosen = [STATS[n] for n in ("Instances", "platform", "lastReported", "topPlugins", "settingsValues", "deviceMemory")]
    for number, batch in enumerate(random_batches()):
        # Reports of one device that agree in time and id must be the same report.
        batch = [(t, i * 1000 + hash_of(v), v) for t, i, v in batch]
        so_far += batch
        assert state.update(parsed(spark, batch), folder, number, chosen=chosen)
        assert not state.update(parsed(spark, batch), folder, number, chosen=chosen)
        snap = engine.snapshot(parsed(spark, so_far), AS_OF)
        assert rows(state.summary(spark, folder, AS_OF, chosen)) == rows(engine.summary(snap, chosen))
        assert rows(state.current_reports(spark, folder).select("uuid", "ts", "report_id")) == rows(snap.select("uuid", "ts", "report_id"))
    later = AS_OF + 5 * HOUR
    assert rows(state.summary(spark, folder, later, chosen)) == rows(engine.summary(engine.snapshot(parsed(spark, so_far), later), chosen))
    with pytest.raises(ValueError):
        state.summary(spark, folder, AS_OF + 1)


def hash_of(text):
    return sum(ord(c) * (i + 1) for i, c in enumerate(text)) % 997


def test_only_buckets_with_news_are_read(spark, tmp_path):
    folder = str(tmp_path)
    first = [(1000 + i, i, json.dumps({"uuid": f"d{i}"})) for i in range(200)]
    few = [STATS["Instances"]]
    state.update(parsed(spark, first), folder, 0, chosen=few)
    before = commits.last_commit(spark, folder)[1]["current"]["paths"]
    state.update(parsed(spark, [(5000, 1, json.dumps({"uuid": "d7"}))]), folder, 1, chosen=few)
    _, now = commits.last_commit(spark, folder)
    assert len(now["touched"]) == 1 and sum(before[b] != p for b, p in now["current"]["paths"].items()) == 1
    hidden = [Path(p) for b, p in before.items() if int(b) not in now["touched"]]
    for p in hidden:  # what isn't there can't be read
        p.rename(p.with_name("_" + p.name))
    assert state.update(parsed(spark, [(6000, 1, json.dumps({"uuid": "d7"}))]), folder, 2, chosen=few)
    for p in hidden:
        p.with_name("_" + p.name).rename(p)
    assert state.current_reports(spark, folder).count() == 200 and state.current_reports(spark, folder).where("uuid = 'd7'").first()["ts"] == 6000


def test_changes_are_summed_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_PARTS", 3)
    folder, chosen = str(tmp_path), [STATS["platform"], STATS["Instances"]]
    for n in range(7):
        state.update(parsed(spark, [(n, n, json.dumps({"uuid": "d", "systemInfo": {"platform": "xy"[n % 2]}}))]), folder, n, chosen=chosen)
    _, now = commits.last_commit(spark, folder)
    assert len(now["changes"]["paths"]) == 2 and len(now["changes"]["parts"]) == 1
    assert [(r["key"], r["totalCount"]) for r in state.summary(spark, folder, HOUR, chosen).where("population = 'all' AND stat = 'platform'").collect()] == [("x", 1)]


def test_new_statistics_are_counted_anew(spark, tmp_path):
    folder, few = str(tmp_path), [STATS["platform"], STATS["lastReported"]]
    batch = [(1000 * i, i, json.dumps({"uuid": f"d{i % 7}", "timezone": f"+0{i % 3}00 X", "systemInfo": {"platform": "xyz"[i % 3]}})) for i in range(20)]
    state.update(parsed(spark, batch[:12]), folder, 0, chosen=few)
    more = [*few, STATS["timeZone"]]
    with pytest.raises(ValueError, match="timeZone"):
        state.summary(spark, folder, HOUR, more)
    with pytest.raises(ValueError, match="recount"):
        state.update(parsed(spark, batch[12:]), folder, 1, chosen=more)
    state.recount(spark, folder, more)
    state.update(parsed(spark, batch[12:]), folder, 1, chosen=more)
    assert rows(state.summary(spark, folder, HOUR, more)) == rows(engine.summary(engine.snapshot(parsed(spark, batch), HOUR), more))


def months_in(spark, folder, data):
    out = spark.createDataFrame(data, "uuid string, time string").withColumn("time", F.to_timestamp("time"))
    out.coalesce(1).write.mode("append").parquet(folder)
    return out.schema


def test_a_device_counts_once_a_month(spark, tmp_path):
    """Five reports in January, each in a batch of its own, and late ones while February runs."""
    land, check = str(tmp_path / "in"), str(tmp_path / "check")
    days = ["2024-01-01", "2024-01-05", "2024-01-11", "2024-01-20", "2024-01-31", "2024-02-10", "2024-01-02", "2024-02-11"]
    for i, day in enumerate(days):
        schema = months_in(spark, land, [("a", day), *([("b", "2024-01-31 23:59:59.999")] if i in (1, 6) else []), ("c", None)])
        stream = ingest.stream_months(spark.readStream.schema(schema).parquet(land))
        query = stream.writeStream.format("memory").queryName(f"months{i}").outputMode("complete").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(spark.table(f"months{len(days) - 1}")) == [("2024-01", 2), ("2024-02", 1)]


def test_months_by_stream_equal_those_of_the_history(spark, sf_dir, tmp_path):
    reports = demo.reports(spark, sf_dir)
    current = engine.snapshot(reports, AS_OF)
    land, folder, check = (str(tmp_path / x) for x in ("in", "months", "check"))
    plain = reports.select("uuid", F.timestamp_millis("ts").alias("time"))
    # A batch for each month or so, in order, as reports come.
    edges = ["1970-01-01", "2000-06-01", "2000-12-15", "2001-03-03", "2001-06-20", "2001-07-01", "2100-01-01"]
    for lo, hi in zip(edges, edges[1:]):
        plain.where((F.col("time") >= lo) & (F.col("time") < hi)).coalesce(1).write.mode("append").parquet(land)
        ingest.keep_months(spark.readStream.schema(plain.schema).parquet(land), folder, check).awaitTermination()
    seen = ingest.read_months(spark, folder)
    assert seen.count() == seen.distinct().count()
    assert rows(history.months_of(seen, current, AS_OF)) == rows(history.unique_by_month(reports, current, AS_OF))


def test_long_bodies_take_little_disk(spark, sf_dir, tmp_path, monkeypatch):
    """A ninth of the uploads have 100,000 characters, 11 MB in all; what lands and what is kept is compressed, and nothing is sorted."""
    monkeypatch.setattr(queries, "scratch", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rejected = queries.stream_ingest(spark, sf_dir).where("status = 'Payload too large'").first()["n"]
    assert rejected * 100_000 > 10_000_000 and sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 1_000_000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_uploads_are_made_by_all_cores(spark, sf_dir):
    assert queries._uploads(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_body_is_parsed_and_written_once(spark):
    plan = ingest.upload_status(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("get_json_object(") == 1 and plan.count("StructsToJsonEvaluator(") == 2, plan  # the report and its stamp


def test_sizes_are_those_of_utf16(spark):
    """At the bound, one below and one above it, for texts of one to four octets, with and without a stamp of their own."""
    bodies, want = [], []
    for letter, units in (("y", 1), ("é", 1), ("€", 1), ("😀", 2)):
        for stamp in ({}, {"ts": 12345}):
            doc = {"uuid": "a", **stamp, "x": ""}
            rest = ingest.MAX_UNITS - len(json.dumps({"uuid": "a", "x": ""}, separators=(",", ":"))) - len(',"ts":7')
            for over in (-1, 0, 1):
                fill = letter * ((rest + over) // units) + "z" * ((rest + over) % units)
                bodies.append(json.dumps(doc | {"x": fill}, ensure_ascii=False, indent=1))
                want.append("Payload too large" if over > 0 else "OK")
    bodies += ["null", " 5", "[ ]", '{"uuid": null}', '{"uuid": 5}', '{"uuid": "a", "uuid": "b"}', None]
    want += ["Not JSON Object", "Not JSON Object", "Invalid Record", "Invalid Record", "OK", "Not JSON", "Not JSON"]
    judged = ingest.upload_status(spark.createDataFrame(list(enumerate(bodies)), "i int, value string"), stamp=7)
    assert [r["status"] for r in judged.orderBy("i").collect()] == want


def test_only_latest_reports_are_parsed_and_replaced_ones_go(spark, tmp_path):
    folder, few, passed = str(tmp_path), [STATS["Instances"], STATS["platform"]], []

    def parse(raw):
        passed.append(raw.count())
        return raw.withColumn("r", parse_report(F.col("value"))).select("uuid", "ts", "report_id", *[f"r.{f}" for f in ingest.parse_fields() if f not in ("uuid", "ts")])

    batches = [[(f"d{i % 3}", 1000 * i + n, i, json.dumps({"uuid": f"d{i % 3}", "systemInfo": {"platform": "xyz"[(i + n) % 3]}})) for i in range(30)] for n in range(2)]
    for n, batch in enumerate(batches):
        state.update(spark.createDataFrame(batch, "uuid string, ts long, report_id long, value string"), folder, n, chosen=few, parse=parse)
    assert passed == [3, 3] and not list(tmp_path.rglob("replaced=true"))
    everything = spark.createDataFrame(batches[0] + batches[1], "uuid string, ts long, report_id long, value string")
    assert rows(state.summary(spark, folder, HOUR, few)) == rows(engine.summary(engine.snapshot(parse(everything), HOUR), few))


def test_demo_uploads_are_the_reports(spark, sf_dir):
    kept = demo.uploads(spark, sf_dir)
    assert rows(kept.select("report_id", "uuid", "ts")) == rows(demo.flat_reports(spark, sf_dir).select("report_id", "uuid", "ts"))
    assert demo.of_uploads(kept).schema == demo.reports(spark, sf_dir).schema
