"""Content-addressed WARC archive: each payload once under its digest, exact record headers apart, joined to read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitus.llm.common import maybe_broadcast, no_text, prepared, stage
from transitus.session import shared_folder

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits, eight letters, at a time."""
    hexed = F.sha1(payload)
    part = lambda k: F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), BASE32_DIGITS, BASE32_LETTERS)


def _urn(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """The exact bytes in front of a record's block; a revisit has no block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn("page_id")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f]", "")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `pages` (page_id, url, html) to `folder`/headers and `folder`/payloads.

    Payloads are addressed by SHA-256. Length and a second hash of all payloads under one digest are compared, and
    the write fails where they differ. Of records with equal payloads of at least `min_revisit_bytes` bytes, those
    with the smallest page_id are responses and the others revisit them; shorter payloads are all responses. A null
    html is an empty payload, a null url has no line, a null page_id is larger than any other. Rows that repeat the
    smallest page_id are responses too, but their payload is stored once. An empty table gives an empty archive.
    """
    payload = no_text("html").cast("binary")
    source = pages.select(
        "page_id", "url", payload.alias("_payload"), F.sha2(payload, 256).alias("sha256"),
    )
    records = stage(
        source.select(
            "page_id", "url", "sha256", F.octet_length("_payload").cast("bigint").alias("payload_bytes"),
            base32_sha1(F.col("_payload")).alias("payload_digest"), F.xxhash64("_payload").alias("_check"),
        ),
        "records",
    )
    shared = stage(
        records.groupBy("sha256").agg(
            F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"),
            (F.min(F.struct("payload_bytes", "_check")) != F.max(F.struct("payload_bytes", "_check"))).alias("_differs"),
        ).filter("_n > 1"),
        "shared",
    )
    if not shared.filter("_differs").isEmpty():
        raise ValueError("two payloads share a digest")
    first = maybe_broadcast(shared.select("sha256", "_first"))
    later = F.col("_shared") & (F.col("payload_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    typed = (
        records.join(first.withColumn("_shared", F.lit(True)), "sha256", "left")
        .withColumn("_later", F.coalesce(later, F.lit(False)))
        .withColumn("record_type", F.when(F.col("_later"), "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(F.col("_later"), F.col("_first")))
    )
    typed.select(_header(date).alias("header"), "sha256").write.parquet(f"{folder}/headers")
    held = source.select("page_id", "sha256", F.col("_payload").alias("payload")).join(
        first.withColumn("_shared", F.lit(True)), "sha256", "left"
    )
    alone = held.filter(F.col("_shared").isNull())
    once = held.filter(F.col("_shared") & F.col("page_id").eqNullSafe(F.col("_first"))).dropDuplicates(["sha256"])
    alone.unionByName(once).select("sha256", "payload").write.parquet(f"{folder}/payloads")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Records as their header bytes tell them: page_id, record_type, refers_to, payload_digest, header, sha256."""
    said = lambda name, pattern: F.regexp_extract(F.col("_said"), f"\r\n{name}: {pattern}\r\n", 1)
    number = lambda text: F.when(text != "", text).cast("bigint")
    return (
        spark.read.schema("header binary, sha256 string").parquet(f"{folder}/headers")
        .withColumn("_said", F.col("header").cast("string"))
        .select(
            number(said("WARC-Record-ID", "<urn:page:([^>]*)>")).alias("page_id"),
            said("WARC-Type", "([^\r]*)").alias("record_type"),
            number(said("WARC-Refers-To", "<urn:page:([^>]*)>")).alias("refers_to"),
            said("WARC-Payload-Digest", "sha1:([^\r]*)").alias("payload_digest"),
            "header", "sha256",
        )
    )


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, payload, with the digest of every payload computed anew; a payload that is not its digest's fails."""
    return spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads").withColumn(
        "payload",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")
        ),
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records: the columns of `read_headers`, payload, and record, the bytes that a WARC file holds for it.

    A revisit's payload is that of the record it refers to; its own block is empty.
    """
    joined = read_headers(spark, folder).join(read_payloads(spark, folder), "sha256")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat("header", block, F.lit(CRLF * 2).cast("binary"))).drop("sha256")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write an archive of `pages` to the shared folder and tell what it holds when read back.

    page_id, payload_bytes, payload_digest, record_type, refers_to; length and digest are those of the payload
    that the archive gives back, and a record whose header says another digest fails.
    """
    spark = prepared(pages.sparkSession)
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_revisit_bytes)
    # measured once for each payload, so that records of one payload share its row, not its bytes
    measured = stage(
        read_payloads(spark, folder).select(
            "sha256", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("_digest")
        ),
        "payloads",
    )
    return read_headers(spark, folder).join(measured, "sha256").select(
        "page_id", "payload_bytes",
        F.when(F.col("_digest") == F.col("payload_digest"), F.col("_digest")).otherwise(
            F.raise_error(F.concat(F.lit("wrong digest in a header of "), F.col("sha256")))
        ).alias("payload_digest"),
        "record_type", "refers_to",
    )
