"""A content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds every distinct payload once under its SHA-256, and how many records have it, ``headers`` holds
the exact header bytes of every record and the key of its payload. Records come back through a join on the key;
reading verifies each payload against its key and against the SHA-1 that the record's header names.

Cases. A null payload is empty. Rows with a null id get ``urn:page:null`` and are never referred to; where all
rows of a payload have null ids, all are responses. Rows that repeat the smallest id of a payload are all
responses. Line breaks in a URL become blanks, a null URL gives no target line. An empty table gives an empty
archive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_spread
from .common import materialise, scratch

_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 hex digits are 20 bits, which are 4 base32 digits."""
    h = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), _DIGITS, _BASE32)


def _key(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes the archive of pages at path. Of records with equal payloads of min_bytes or more, the one with the smallest id is the response and the others revisit it.

    Payload bytes cross one shuffle, after each map task has dropped its own repeats; types are settled on ids and digests alone, so a payload that a third of all rows share costs one copy a task, and the rows that share it are dealt over tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows.select(_key(F.col("payload")).alias("key"), "payload").groupBy("key").agg(F.first("payload").alias("payload"), F.count("*").alias("records")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    narrow = rows.select("id", "url", _key(F.col("payload")).alias("key"), F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    first = materialise(narrow.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("first_id"), F.count("*").alias("records")), "first")
    typed = join_spread(narrow, first, ["key"], ["k"], "records", ["id", "url"]).withColumn("revisit", (F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    block = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    typed = typed.withColumn("http", http)
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "  ")), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    typed.select(F.encode(warc, "UTF-8").alias("header"), F.encode("http", "UTF-8").alias("http"), F.col("key").alias("payload_key")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    h = F.decode("header", "UTF-8")
    number = lambda name: F.regexp_extract(_field(h, name), r"<urn:page:(\d+|-\d+)>", 1).try_cast("long")
    return spark.read.schema("header binary, http binary, payload_key binary").parquet(f"{path}/headers").select(
        "header", "http", "payload_key", number("WARC-Record-ID").alias("page_id"), _field(h, "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.substring_index(_field(h, "WARC-Payload-Digest"), "sha1:", -1).alias("payload_digest"), _field(h, "WARC-Target-URI").alias("url"))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with what is needed to check them; a payload that doesn't match its key ends the job."""
    return spark.read.schema("key binary, payload binary, records long").parquet(f"{path}/payloads").select(
        "key", "payload", "records", F.when(_key(F.col("payload")) == F.col("key"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("long")).alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))


def _joined(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    stored = _payloads(spark, path).select("key", "records", "payload_bytes", "sha1", *columns)
    return join_spread(_headers(spark, path), stored, ["payload_key"], ["key"], "records", ["header"], "left").withColumn(
        "payload_bytes", F.when(F.col("sha1").eqNullSafe(F.col("payload_digest")), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs from its header")).cast("long")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, from its own header, with verified payload size and digest; payload bytes don't cross the join."""
    return _joined(spark, path).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A row per record with its full payload, revisits included."""
    return _joined(spark, path, "payload").select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record with the exact bytes of the WARC record."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return _joined(spark, path, "payload").select("page_id", "record_type", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"), "payload_bytes")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages into a new archive in the shared folder and reads its index back."""
    spark = pages.sparkSession
    return read_index(spark, write_archive(pages, scratch(spark, "warc"))).drop("url")
