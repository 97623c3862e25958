"""Content-addressed WARC archive: payloads once by SHA-256, exact record headers beside them.

An archive is a folder with two tables. ``payloads`` has each distinct payload once under its
SHA-256. ``records`` has the exact header bytes of every record (WARC header and HTTP header) and
the address of its payload. Records are rebuilt by joining both; each payload read is digested
again and must give its address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every 5 hex digits are 4 digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    # Digits of base 32 by value, then by the alphabet of RFC 4648.
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write one record per row of ``pages``; the payload is ``body`` in UTF-8 (null: empty).

    Of records with equal payloads that with the smallest key is the response and the others
    revisit it. Null keys come last; rows equal in key, url and payload are numbered, and the
    first of them is the smallest. A null url is written as empty. Other columns are not read.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    stored = rows.groupBy("address").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{folder}/payloads")

    slim = rows.select("id", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    counted = slim.groupBy("id", "url", "address", "bytes", "sha1").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "url")
    # Written first: both sides of the join below are then plain reads, and AQE may split a hot address.
    counted.write.parquet(f"{folder}/counted")
    counted = pages.sparkSession.read.schema(counted.schema).parquet(f"{folder}/counted")
    firsts = counted.groupBy("address").agg(F.min(order).alias("first"))
    firsts.write.parquet(f"{folder}/firsts")
    firsts = pages.sparkSession.read.schema(firsts.schema).parquet(f"{folder}/firsts")
    each = counted.join(firsts, "address").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    response = order.eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    each = each.withColumn("type", F.when(response, "response").otherwise("revisit"))
    each = each.withColumn("refers_to", F.when(~response, F.col("first.id")))
    each = each.withColumn("record_id", _record_id(F.col("id"), F.col("url"), F.col("address"), F.col("copy")))
    each = each.withColumn("first_record", _record_id(F.col("first.id"), F.col("first.url"), F.col("address"), F.lit(1)))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    each = each.withColumn("http_header", http.cast("binary"))
    whole = F.octet_length("http_header") + F.when(response, F.col("bytes")).otherwise(F.lit(0))
    refers = F.when(
        ~response,
        F.concat(
            F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), F.col("first_record"),
            F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.col("first.url"), F.lit(CRLF),
        ),
    )
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), F.col("record_id"),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(CRLF),
        F.coalesce(refers, F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), whole.cast("string"), F.lit(CRLF + CRLF),
    )
    records = each.select("id", "refers_to", "record_id", "type", header.cast("binary").alias("warc_header"), "http_header", "address")
    records.write.parquet(f"{folder}/records")


def _record_id(key: Column, url: Column, address: Column, copy: Column) -> Column:
    """Name-based: the same row gets the same id on a retry."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("-")), url, address, copy.cast("string")), 256)
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i, n) for i, n in at)), F.lit(">"))


def _lines(*lines: str | Column) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in lines]
    return F.concat(F.concat_ws(CRLF, *parts), F.lit(CRLF + CRLF))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``address, payload``; reading a payload that doesn't give its address fails."""
    stored = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("stored payload doesn't match its address")).cast("binary"))
    return stored.select("address", checked.alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the archive with header fields, the payload's own length and digest, and the payload.

    ``id`` and ``refers_to`` keep the key's type; the rest of a row is taken from the header bytes
    and the stored payload. A digest in a header that the payload doesn't have fails.
    """
    heads = spark.read.parquet(f"{folder}/records")
    body = read_payloads(spark, folder)
    body = body.select("address", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    text = F.col("warc_header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1)
    said = field("WARC-Payload-Digest")
    digest = F.when(said == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("payload digest differs")))
    return heads.join(body, "address").select(
        "id", "refers_to", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("url"), "payload_bytes", digest.alias("payload_digest"), "payload", "warc_header", "http_header",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``id, record_id, record``: the exact bytes of every WARC record of ``read_records``."""
    end = F.lit(CRLF + CRLF).cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("id", "record_id", F.concat("warc_header", "http_header", body, end).alias("record"))
