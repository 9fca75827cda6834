"""WARC as a content-addressed archive.

write_archive() makes two tables: headers, one row per record with its exact header bytes, and
payloads, the bytes of each distinct payload once under its SHA-256. read_archive() parses the
headers again, verifies each stored payload against its key and joins the two; reconstruct()
gives back whole records, byte for byte.

Of records with equal payloads of at least least_bytes, the one with the largest page id is the
response and the others revisit it; smaller ones are all responses (their bytes are stored once
nevertheless).

Defined results: null html is an empty payload; a null url has no target header; line breaks in a
url are percent-encoded, its other characters stay; a record whose payload is lost stops the reader; a null page id is
below all others; of repeated rows with the largest id exactly one is the response and the others
revisit it; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

LEAST_BYTES, DATE = 1000, "2024-01-01T00:00:00Z"
END = "\r\n"


def _field(name: str, value):
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _with_payload(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    return p.withColumn("digest", F.sha2("payload", 256))


def write_archive(pages: DataFrame, path: str, id_col="page_id", url_col="url", html_col="html", least_bytes=LEAST_BYTES) -> None:
    with_payload = _with_payload(pages, id_col, url_col, html_col)
    with_payload.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    r = with_payload.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("n"))
    r = staged(r, "warc-records")
    large = r.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("first"), F.count("*").alias("copies"))
    large = large.filter("copies > 1").select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_page"), F.col("first.n").alias("first_n"))
    r = r.join(large, F.col("digest") == F.col("_digest"), "left")
    revisit = F.coalesce(F.col("first_n") != F.col("n"), F.lit(False))
    record_id = lambda n: F.concat(F.lit("<urn:sha1:"), F.sha1(n.cast("string")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", record_id(F.col("n"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", safe_url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, record_id(F.col("first_n")))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("X-Refers-To-Page-ID", F.when(revisit, F.col("first_page").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(END),
        http,
    )
    r.select(F.encode(head, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; one whose bytes do not have its digest stops the job."""
    p = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return p.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have its digest: "), "digest"))))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of each record's own header block, which ends at the first empty line. Lines end at a line feed only, whatever else a url holds."""
    h = spark.read.schema("header binary").parquet(f"{path}/headers").withColumn("_text", F.substring_index(F.decode("header", "UTF-8"), END + END, 1))
    value = lambda name: F.nullif(F.regexp_extract("_text", rf"(?md)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))
    return h.select(
        "header", value("X-Page-ID").cast("long").alias("page_id"), value("WARC-Target-URI").alias("url"), value("WARC-Type").alias("record_type"),
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), value("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def _joined(spark: SparkSession, path: str, *columns) -> DataFrame:
    """Headers with columns of their payloads; a record whose payload is not there stops the job."""
    p = _payloads(spark, path).select(F.col("digest").alias("_digest"), *columns)
    h = _headers(spark, path)
    j = h.join(p, h["digest"] == F.col("_digest"), "left")
    lost = F.raise_error(F.concat(F.lit("no payload for the record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return j.withColumn("record_type", F.when(F.col("_digest").isNull(), lost).otherwise(F.col("record_type")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest (SHA-1 of the full payload), record_type, refers_to."""
    j = _joined(spark, path, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return j.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, payload (of revisits too) and record, the original record's bytes."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return _joined(spark, path, "payload").select("page_id", "record_type", "payload", F.concat("header", body, F.lit((END + END).encode())).alias("record"))
