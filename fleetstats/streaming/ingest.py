"""Ingest of uploads, as a batch or a stream: validate, stamp, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.commits import clean, commit, described, exists, grown, last_commit, new_path, opened
from ..sources.landing import latest_report
from ..sources.schema import parse_report
from ..sources.shared import unsorted
from .state import update

#: Longest report in UTF-16 units, its stamp included.
MAX_UNITS = 100_000


def utf16_units(c: Column) -> Column:
    """ASCII, as most reports are, has as many units as octets and isn't encoded again."""
    return F.when(F.octet_length(c) == F.char_length(c), F.char_length(c)).otherwise(F.octet_length(F.encode(c, "UTF-16BE")) / 2)


def upload_status(uploads: DataFrame, value: str = "value", stamp: Column | int = 0) -> DataFrame:
    """``uploads`` with ``status``, ``uuid`` ('' unless the format is right) and ``ts``. A body is parsed once and written again once."""
    stamped = F.lit(stamp) if isinstance(stamp, int) else stamp
    # Each of these is a projection of its own, so that what follows reads columns.
    out = uploads.withColumn("_parsed", F.try_parse_json(value))
    out = out.withColumns({"_again": F.to_json("_parsed"), "_ts": F.to_json(F.try_variant_get("_parsed", "$.ts", "variant")), "_uuid": F.get_json_object(value, "$.uuid")})
    again, uuid = F.col("_again"), F.col("_uuid")
    # Of the report as it is written again: without white space, with its stamp in place of one that it has.
    size = utf16_units(again) - F.when(F.col("_ts") != "null", F.length("_ts") + len(',"ts":')).otherwise(0) + F.length(F.concat(F.lit(',"ts":'), stamped.cast("string")))
    status = (
        F.when(F.col("_parsed").isNull(), "Not JSON")
        .when(~again.startswith("{"), F.when(again.startswith("["), "Invalid Record").otherwise("Not JSON Object"))
        .when(uuid.isNull(), "Invalid Record")
        .when(uuid.rlike(r"[^A-Za-z0-9\-]"), "Invalid UUID Format")
        .when(size > MAX_UNITS, "Payload too large")
        .otherwise("OK")
    )
    out = out.withColumn("status", status).withColumn("ts", stamped.cast("long"))
    return out.withColumn("uuid", F.when(F.col("status").isin("OK", "Payload too large"), uuid).otherwise("")).drop("_parsed", "_again", "_ts", "_uuid")


def split(uploads: DataFrame, stamp: Column | int, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): parsed reports with their payload, and payloads with the reason."""
    judged = upload_status(uploads, value, stamp)
    accepted = judged.where("status = 'OK'").withColumn("report", parse_report(F.col(value)))
    rest = [f for f in parse_fields() if f not in ("uuid", "ts")]
    accepted = accepted.select("uuid", "ts", F.col(value).alias("payload"), F.xxhash64(value).alias("report_id"), *[f"report.{f}" for f in rest])
    return accepted, judged.where("status != 'OK'").select(F.col(value).alias("payload"), "status", "ts")


def parse_fields() -> list[str]:
    from pyspark.sql.types import StructType

    from ..sources.schema import REPORT_DDL

    return StructType.fromDDL(REPORT_DDL).fieldNames()


def ingest_batch(uploads: DataFrame, folder: str, number: int, stamp: int, value: str = "value", source: str = "stream") -> bool:
    """Take in batch ``number`` of ``source``, whose numbers rise: bodies are judged and stamped, written, and then named by one commit.

    False if the batch was taken in before. What a stopped run has written without its commit is never read.
    """
    spark = uploads.sparkSession
    after, state = last_commit(spark, folder)
    if state.get("sources", {}).get(source, -1) >= number:
        return False
    judged = upload_status(uploads, value, stamp).select("uuid", "ts", F.col(value).alias("payload"), F.xxhash64(value).alias("report_id"), "status")
    path = new_path(folder)
    with unsorted(spark, 2):
        judged.withColumn("accepted", F.col("status") == "OK").write.partitionBy("accepted").option("compression", "zstd").parquet(path)
    tables, last = {}, []
    for name, part in (("history", f"{path}/accepted=true"), ("rejected", f"{path}/accepted=false")):
        table = state.get("tables", {}).get(name) or described(judged.schema, [])
        found = exists(spark, part)
        tables[name] = grown(spark, folder, table, part) if found else table
        last += [part] if found and name == "history" else []
    commit(spark, folder, {"sources": state.get("sources", {}) | {source: number}, "tables": tables, "last": described(judged.schema, last)}, after)
    clean(spark, folder)
    return True


def stream_ingest(spark: SparkSession, landing: str, folder: str, checkpoint: str, stamp: int, lines: bool = False, kept: str | None = None, files: int | None = None) -> StreamingQuery:
    """Everything that has landed and wasn't ingested yet goes to ``folder``. A file is one body, or with ``lines`` each of its lines is.

    ``kept``: a folder where the latest reports and the summary are kept up as well. ``files``: how many make a batch at most.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    bodies = (reader if files is None else reader.option("maxFilesPerTrigger", files)).text(landing, wholetext=not lines)

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, folder, number, stamp + number)
        if kept is not None:
            # The last batch is this one, also if it was stopped between the two commits.
            update(opened(spark, last_commit(spark, folder)[1]["last"]), kept, number, parse=_parsed)

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """Ingested reports, parsed."""
    return _parsed(opened(spark, last_commit(spark, folder)[1].get("tables", {}).get("history")))


def _parsed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("report", parse_report(F.col("payload")))
    return rows.select("uuid", "ts", "report_id", *[f"report.{f}" for f in parse_fields() if f not in ("uuid", "ts")])


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """payload, status, ts of the bodies that weren't accepted."""
    _, state = last_commit(spark, folder)
    return opened(spark, state.get("tables", {}).get("rejected")).select("payload", "status", "ts")


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest report of each device, computed on read from what the stream has written; ``state.current_reports`` has it without that."""
    return latest_report(read_history(spark, folder))


#: How long after the end of a month its reports may still come, at least, once later months have begun.
LATE = "31 days"


def device_months(events: DataFrame, device: str = "uuid", time: str = "time", late: str = LATE) -> DataFrame:
    """Of a stream: each device once a month, at its first report of the month that comes.

    The state's key is (device, month) and lives until the month's end is ``late`` behind the end of the newest month, so with the default the
    month before is still open while the present one runs, and reports of older months are too late. Reports without a time aren't counted.
    """
    month = F.date_trunc("month", F.col(time))
    end = (F.add_months(month, 1).cast("timestamp") - F.expr("interval 1 millisecond")).alias("month_end")
    return events.where(F.col(time).isNotNull()).select(F.col(device).alias("device"), end).withWatermark("month_end", late).dropDuplicates(["device", "month_end"])


def stream_months(events: DataFrame, device: str = "uuid", time: str = "time", late: str = LATE) -> DataFrame:
    """Of a stream: devices per month, each counted once."""
    months = device_months(events, device, time, late).withColumn("month", F.date_format("month_end", "yyyy-MM"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("devices"))


def keep_months(events: DataFrame, folder: str, checkpoint: str, device: str = "uuid", time: str = "time", late: str = LATE) -> StreamingQuery:
    """Write the stream's devices by month to ``folder``, batch by batch, each once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        after, state = last_commit(spark, folder)
        if state.get("batch", -1) < number:
            path = new_path(folder)
            found = batch.select(F.col("device").alias("uuid"), F.to_date(F.date_trunc("month", "month_end")).alias("first"))
            found.write.parquet(path)
            commit(spark, folder, {"batch": number, "months": grown(spark, folder, state.get("months") or described(found.schema, []), path)}, after)
            clean(spark, folder)

    return device_months(events, device, time, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_months(spark: SparkSession, folder: str) -> DataFrame:
    """uuid, first: the months (their first days) in which each device has reported."""
    return opened(spark, last_commit(spark, folder)[1].get("months"))
