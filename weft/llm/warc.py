"""A content-addressed web archive: payload bytes once, exact record headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: RFC 4648 base 32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(hex_digest: Column) -> Column:
    """Base 32 of a 160-bit digest given as 40 hex digits: 5 hex digits are 4 letters."""
    letters = []
    for i in range(8):
        value = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def _one_line(text: Column) -> Column:
    """A header value cannot hold a line break; CR and LF are percent-encoded."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write a record for each page under ``root``: ``records`` (exact header blocks) and
    ``payloads`` (each distinct payload once, under its SHA-256).

    Among pages with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response and the others revisit it. Digests that agree while lengths or
    SHA-1 values differ stop the job. Grouping is combined map-side, so a payload that a third
    of all pages share moves as one row a task.

    Defined cases: null html is the empty payload; a null url leaves the URI header out; a page
    with a null id never owns a payload that another page owns, and is then a revisit; rows that
    repeat an owner's id are responses too; an empty table writes two empty tables.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    index = durable(
        pages.select(
            F.col("page_id"),
            F.col("url"),
            F.sha2(payload, 256).alias("key"),
            F.octet_length(payload).cast("long").alias("n"),
            base32_of_hex(F.sha1(payload)).alias("sha1"),
        ),
        "warc-index",
    )
    differs = (F.min("n") != F.max("n")) | (F.min("sha1") != F.max("sha1"))
    owners = index.groupBy("key").agg(
        F.when(differs, F.raise_error(F.lit("payloads differ under one digest")).cast("long"))
        .otherwise(F.max("page_id"))
        .alias("owner")
    )
    response = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("n") < min_bytes)
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    page = lambda c: F.format_string("<urn:weft:page:%s>", c.cast("string"))
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), page(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), page(F.col("owner")))),
        F.when(
            ~response,
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("n")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    ).cast("binary")
    index.join(owners, "key").select("page_id", "key", header.alias("header")).write.parquet(f"{root}/records")
    stored = pages.select(F.sha2(payload, 256).alias("key"), payload.alias("payload"))
    (
        stored.groupBy("key")
        .agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{root}/payloads")
    )


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Rebuild the records by a join of headers and payloads.

    Columns: page_id, header, record_type, refers_to, payload_bytes, payload_digest, payload
    (whole, also for revisits) and record (the bytes of the WARC record: header, then the
    payload of a response, then two line ends). Every payload is checked against its key, and
    its SHA-1 against the header. Columns that a query does not select are not moved.
    """
    body = F.col("payload")
    whole = F.sha2(body, 256) == F.col("key")
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("key")))
    payloads = spark.read.parquet(f"{root}/payloads").select(
        F.col("key"),
        F.when(whole, F.octet_length(body).cast("long")).otherwise(bad.cast("long")).alias("payload_bytes"),
        F.when(whole, base32_of_hex(F.sha1(body))).otherwise(bad.cast("string")).alias("computed"),
        body,
    )
    said = F.col("header").cast("string")
    records = spark.read.parquet(f"{root}/records").select(
        "page_id",
        "key",
        "header",
        F.regexp_extract(said, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.regexp_extract(said, r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1).alias("declared"),
        F.nullif(F.regexp_extract(said, r"\r\nWARC-Refers-To: <urn:weft:page:(-?\d+)>\r\n", 1), F.lit(""))
        .cast("long")
        .alias("refers_to"),
    )
    sent = F.when(F.col("record_type") == "response", body).otherwise(F.lit(b""))
    return records.join(payloads, "key").select(
        "page_id",
        "header",
        "record_type",
        "refers_to",
        "payload_bytes",
        F.when(F.col("computed") == F.col("declared"), F.col("computed"))
        .otherwise(F.raise_error(F.lit("a header's digest differs from its payload")).cast("string"))
        .alias("payload_digest"),
        "payload",
        F.concat(F.col("header"), sent, F.lit(b"\r\n\r\n")).alias("record"),
    )
