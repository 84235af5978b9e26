"""State kept batch by batch: the latest report of each device, and the summary as counts by change.

The latest reports lie in buckets by a hash of the device. A batch reads and rewrites only the buckets of devices that it has reports of, and leaves
behind how the statistics changed: what its reports count, and less what those count that they take the place of. A change names the
statistic, series, key, population and time of report, so windows, which move with the clock, are sums of changes when read.
One commit holds all that a batch did; a batch that comes again does nothing.

Times are kept exactly at full grains (hours) and as the middle of a grain between them, which no window or age bin at a full
grain can tell from the exact time. So a summary may be asked for at every full grain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ages import DAY_MS, age_class, age_ms
from ..operators.registry import STATS, Stat
from ..plans import engine
from ..sources.commits import clean, commit, described, exists, grown, last_commit, new_path, opened
from ..sources.landing import latest_report
from ..sources.shared import drop, stored, unsorted

BUCKETS = 64
GRAIN_MS = 3_600_000
KEY = ("stat", "series", "key", "is_docker", "time")
#: Counts devices as such; its changes serve statistics of age.
_DEVICES = Stat("", "", fixed=lambda: [("", F.lit(""))])


def bucket_of(device: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int")


def grain_time(ts: Column, grain: int) -> Column:
    """The time itself at a full grain, else the middle of its grain."""
    start = ts - F.pmod(ts, F.lit(grain))
    return F.when(ts == start, ts).otherwise(start + grain // 2)


def _reports(spark: SparkSession, current: dict, buckets: list[str]) -> DataFrame:
    return opened(spark, {"schema": current["schema"], "paths": [current["paths"][b] for b in buckets if b in current["paths"]], "parts": []})


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n != 0")


def _changes(signed: DataFrame, grain: int, chosen: list[Stat]) -> DataFrame:
    """KEY and n: what reports of ``sign`` 1 count, less what those of ``sign`` -1 do. Each family counts keys of its own, so none comes twice."""
    signed = signed.withColumn("is_docker", engine.is_docker()).withColumn("time", grain_time(F.col("ts"), grain))
    return engine.counted(signed, [_DEVICES, *(s for s in chosen if not s.of_age)], ("is_docker", "time"), F.col("sign"), gated=False).where("n != 0")


def update(
    reports: DataFrame, folder: str, number: int, source: str = "stream", buckets: int = BUCKETS, grain: int = GRAIN_MS, chosen: list[Stat] | None = None,
    parse: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> bool:
    """Take in batch ``number`` of ``source``: reports with uuid, ts and report_id. False if it was taken in before.

    Numbers of a source rise. Late reports change nothing; of equal times the larger report_id is later; equal reports are one. ``buckets``,
    ``grain`` and the names of the statistics hold from the first batch on; see ``recount``. ``parse`` makes parsed reports, with the same three columns, of rows like
    ``reports``; only the latest of each device go through it.
    """
    spark = reports.sparkSession
    after, state = last_commit(spark, folder)
    if state.get("sources", {}).get(source, -1) >= number:
        return False
    buckets, grain = state.get("buckets", buckets), state.get("grain", grain)
    stats = list(STATS.values()) if chosen is None else chosen
    counted = _names(stats)
    if state.get("stats", counted) != counted:
        raise ValueError("other statistics are kept; recount them first")
    latest = stored(latest_report(reports))
    touched = sorted(r[0] for r in latest.select(bucket_of("uuid", buckets)).distinct().collect())  # at most ``buckets`` numbers
    news = parse(latest).withColumn("since", F.lit(after + 1).cast("long"))
    current = state.get("current", {"schema": news.schema.jsonValue(), "paths": {}})
    changes = state.get("changes")
    if touched:
        names = [str(b) for b in touched]
        # A task for each bucket, which lays the reports that stay beside those that news have taken the place of.
        both = _reports(spark, current, names).unionByName(news).withColumn("bucket", bucket_of("uuid", buckets))
        both = both.withColumn("_task", (F.array_position(F.lit(touched), F.col("bucket")) - 1).cast("int")).repartitionById(len(touched), "_task")
        order = Window.partitionBy("_task", "uuid").orderBy(F.col("ts").desc_nulls_last(), F.col("report_id").desc_nulls_last(), "since")
        both = both.withColumn("_place", F.row_number().over(order)).withColumn("_by", F.first("since").over(order))
        kept = both.withColumn("replaced", F.col("_place") > 1).where((F.col("_place") == 1) | ((F.col("_by") == after + 1) & (F.col("since") <= after)))
        path = new_path(folder)
        with unsorted(spark, 2):
            kept.drop("_task", "_place", "_by").write.partitionBy("replaced", "bucket").parquet(path)
        current = {"schema": current["schema"], "paths": current["paths"] | {b: f"{path}/replaced=false/bucket={b}" for b in names}}
        signed = _reports(spark, current, names).where(F.col("since") == after + 1).withColumn("sign", F.lit(1))
        if exists(spark, old := f"{path}/replaced=true"):
            signed = signed.unionByName(_reports(spark, current | {"paths": {"": old}}, [""]).drop("bucket").withColumn("sign", F.lit(-1)))
        changed = _changes(signed, grain, stats)
        counts = new_path(folder)
        changed.write.parquet(counts)
        drop(spark, old)
        changes = grown(spark, folder, changes or described(changed.schema, []), counts, _summed)
    content = {"sources": state.get("sources", {}) | {source: number}, "buckets": buckets, "grain": grain, "stats": counted, "current": current, "changes": changes, "touched": touched}
    commit(spark, folder, content, after)
    clean(spark, folder)
    return True


def _names(stats: list[Stat]) -> list[str]:
    """Of those that are kept; statistics of age are counted when read."""
    return sorted(s.name for s in stats if not s.of_age)


def recount(spark: SparkSession, folder: str, chosen: list[Stat] | None = None) -> None:
    """Count all latest reports anew, for statistics that are new or have changed."""
    after, state = last_commit(spark, folder)
    stats, reports = list(STATS.values()) if chosen is None else chosen, current_reports(spark, folder)
    changed, path = _changes(reports.withColumn("sign", F.lit(1)), state["grain"], stats), new_path(folder)
    changed.write.parquet(path)
    commit(spark, folder, state | {"stats": _names(stats), "changes": described(changed.schema, [path])}, after)
    clean(spark, folder)


def current_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The latest report of each device, as of the last batch."""
    _, state = last_commit(spark, folder)
    return _reports(spark, state["current"], list(state["current"]["paths"])).drop("since")


def summary(spark: SparkSession, folder: str, as_of: int, chosen: list[Stat] | None = None) -> DataFrame:
    """The summary at a full grain, from changes alone; no report is read. Equal to that of a snapshot of all reports so far."""
    _, state = last_commit(spark, folder)
    if as_of % state["grain"]:
        raise ValueError(f"as_of must be a multiple of {state['grain']} ms")
    stats = list(STATS.values()) if chosen is None else chosen
    if missing := set(_names(stats)) - set(state["stats"]):
        raise ValueError(f"not kept, recount them first: {sorted(missing)}")
    if state["changes"] is None:
        return engine.summary(engine.aged(current_reports(spark, folder), as_of), stats)
    rows = _summed(opened(spark, state["changes"]))
    rows = rows.withColumn("age_ms", age_ms(F.col("time"), as_of)).withColumn("age_class", age_class(F.col("age_ms")))
    plain = rows.where(F.col("stat").isin([s.name for s in stats if not s.of_age]))
    for s in stats:
        if s.max_age_days is not None:
            plain = plain.where((F.col("stat") != s.name) | F.col("age_ms").isNull() | (F.col("age_ms") <= s.max_age_days * DAY_MS))
    parts = plain.select("stat", "series", "key", *engine.CARRIED, "n")
    if by_age := [s for s in stats if s.of_age]:
        parts = parts.unionByName(engine.counted(rows.where("stat = ''"), by_age, n=F.col("n")))
    return engine.windows(parts)
