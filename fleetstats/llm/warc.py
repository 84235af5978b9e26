"""WARC archives: writing with revisit records, and transaction assembly.

Every capture is three records: a request, a response (or, where an earlier capture has the same payload, a revisit) and
metadata. The request and the metadata name their response or revisit as ``WARC-Concurrent-To``. Reading parses the archives by
Content-Length and brings the three together by that identifier, as one nested row per capture.

Archives are gzip files that Spark writes and reads, each of a bounded number of records. Null payloads and urls are empty. A row
that repeats a page id is a capture of its own, with a number in its identifiers; what refers to the id refers to the first. Other columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_at_exit, join_hot, maybe_broadcast, shared_dir, stored

CRLF = "\r\n"
#: Payloads under this many bytes are always stored.
LEAST_REVISIT = 100
#: Records of a file; of pages with payloads of LARGE bytes and more, as many as make FILE_BYTES at most (one page at least).
RECORDS_PER_FILE, LARGE, FILE_BYTES = 1500, 128 << 10, 192 << 20
#: Bytes unpacked at once, and of records sent on at once, about.
PIECE, BATCH_BYTES = 1 << 20, 16 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, block binary"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, refers_to: of equal payloads of LEAST_REVISIT bytes, the first page is stored."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    rows = _numbered(rows)
    large = rows.where(F.col("size") >= LEAST_REVISIT)
    firsts = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = join_hot(rows, firsts, "digest")
    return rows.withColumn("refers_to", F.when((F.col("first") < F.col("page_id")) & (F.col("size") >= LEAST_REVISIT), F.col("first"))).drop("first")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: 0, or the running number of a row whose page id others have too."""
    repeated = stored(rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page_id").alias("_id")))
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    known = maybe_broadcast(repeated)
    again = rows.join(known, same, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url")) - 1)
    return rows.join(known, same, "left_anti").withColumn("copy", F.lit(0)).unionByName(again)


def _urn(kind: str, page, copy=None):
    number = F.lit("") if copy is None else F.when(copy > 0, F.concat(F.lit("-"), copy.cast("string"))).otherwise("")
    return F.concat(F.lit(f"<urn:page:{kind}"), number, F.lit(":"), page.cast("string"), F.lit(">"))


def _record(kind: str, record_id, block, length, headers: list[tuple[str, object]]):
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: "), record_id]
    for name, value in headers:
        head += [F.lit(f"{CRLF}{name}: "), value]
    return F.concat(*head, F.lit(f"{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2), block)


def write_archives(planned: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Three records for each row of ``plan``, as gzip WARC files."""
    page, uri = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.regexp_replace("url", r"[\r\n]", "")
    copy = F.col("copy")
    main, digest = _urn("capture", page, copy), F.concat(F.lit("sha256:"), F.col("digest"))
    asked = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF * 2}"))
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}"
    notes = F.concat(F.lit("page-id: "), page, F.lit(f"{CRLF}payload-length: "), F.col("size").cast("string"), F.lit(CRLF))
    request = _record("request", _urn("request", page, copy), asked, F.octet_length(asked), [("WARC-Concurrent-To", main), ("WARC-Target-URI", uri)])
    metadata = _record("metadata", _urn("metadata", page, copy), notes, F.octet_length(notes), [("WARC-Concurrent-To", main), ("WARC-Target-URI", uri)])
    response = _record("response", main, F.concat(F.lit(head), F.col("payload")), F.col("size") + len(head), [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)])
    revisit = _record("revisit", main, F.lit(head), F.lit(len(head)), [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", _urn("capture", F.col("refers_to")))])
    records = planned.select("size", F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    largest = planned.where(F.col("size") >= LARGE).agg(F.max("size")).first()[0]
    small = records if largest is None else records.where(F.col("size") < LARGE)
    writes = [(small, records_per_file)] + ([] if largest is None else [(records.where(F.col("size") >= LARGE), max(3, FILE_BYTES // largest))])
    for rows, most in writes:
        rows.select("value").write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _unpacked(packed: pa.Buffer) -> Iterator[bytes]:
    """The contents of a gzip file by pieces."""
    unzip, data = zlib.decompressobj(wbits=47), memoryview(packed)
    for at in range(0, len(data), PIECE):
        left = data[at : at + PIECE]
        while len(left):
            yield unzip.decompress(left, PIECE)
            left = unzip.unconsumed_tail
    yield unzip.flush()


def _records(packed: pa.Buffer) -> Iterator[tuple]:
    """The records of an archive; only the one that is being read is in memory."""
    keys = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
    data, at = bytearray(), 0
    for piece in _unpacked(packed):
        data += piece
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            lines = data[at:end].decode().split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record where one should begin")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            stop = end + 4 + int(fields["content-length"])
            if len(data) < stop + 4:
                break
            yield (*map(fields.get, keys), bytes(data[end + 4 : stop]))
            at = stop + 4
        del data[:at]
        at = 0
    if data:
        raise ValueError("an archive ends within a record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], names=names)

    for b in batches:
        for packed in b[0]:
            rows, size = [], 0
            for row in _records(packed.as_buffer()):
                rows.append(row)
                size += len(row[-1])
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, in the archives' own terms."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, and request, response (or revisit) and metadata as structs.

    The three meet by the capture's identifier, which requests and metadata have as concurrent-to; a single grouping, so that
    archives are read and parsed once. A capture that lacks a request or metadata has null there; without a response it isn't one. Of several
    records of one kind and capture one is taken.
    """
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    own = F.struct("warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "block")
    kinds = {"request": ("request",), "response": ("response", "revisit"), "metadata": ("metadata",)}
    met = records.groupBy(key).agg(*(F.first(F.when(F.col("warc_type").isin(*types), own), ignorenulls=True).alias(name) for name, types in kinds.items()))
    return met.select("capture_id", "response", "request", "metadata").where("response IS NOT NULL")


def captures(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and assemble them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan(pages), path)
    drop_at_exit(spark, path)
    return assemble(read_archives(spark, path))


def op8_warc(spark, sf_dir):
    from .common import table

    found = captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    notes = F.decode(F.col("metadata.block"), "utf-8")
    number = lambda c: F.nullif(F.regexp_extract(c, r":([0-9-]+)>$", 1), F.lit("")).cast("long")
    head_end = F.instr(F.col("response.block").cast("string"), CRLF * 2) + 3
    body = F.expr("substring(response.block, _end + 1)")
    found = found.withColumn("_end", head_end).withColumn("_revisit", F.col("response.warc_type") == "revisit").withColumn("_body", body)
    digest = F.when(F.col("_revisit"), F.substring("response.payload_digest", 8, 64)).otherwise(F.sha2("_body", 256))
    return found.select(
        number(F.col("capture_id")).alias("page_id"),
        F.when(F.col("_revisit"), F.regexp_extract(notes, r"payload-length: ([0-9]+)", 1).cast("long")).otherwise(F.octet_length("_body").cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
