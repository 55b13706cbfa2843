"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import maybe_broadcast, no_text, stage, text_key

PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame, normalise: Callable[[Column], Column] | None = None, digest_all: bool = False
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Rows whose texts are equal after `normalise` (None: no change) form a group; that with the largest doc_id is
    kept. Of rows that also repeat the doc_id exactly one is kept. A null text is an empty text, a null doc_id is
    smaller than any other. `text_sha256` is null for texts that the length or the prefix shows to be alone,
    unless `digest_all`. An empty table gives an empty result; other columns of `docs` are not looked at.

    The digest is of the whole text only where length and prefix are shared; `text_key` reads every text. If the list of shared (length, prefix) is
    too long to broadcast, hashing in the scan is cheaper than shuffling texts, and only hashes are shuffled.
    """
    text = no_text("text") if normalise is None else normalise(no_text("text"))
    rows = docs.select("doc_id", text_key("text").alias("text_key"), text.alias("_text")).select(
        "*",
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64(F.substring("_text", 1, PREFIX_CHARS)).alias("_prefix"),
    )
    sizes = stage(rows.select("_bytes", "_prefix"), "sizes")
    lengths = sizes.groupBy("_bytes").count().filter("count > 1").select("_bytes")
    shared = stage(
        sizes.join(lengths, "_bytes", "left_semi").groupBy("_bytes", "_prefix").count().filter("count > 1").drop("count"),
        "shared",
    )
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    few = maybe_broadcast(shared)
    if few is shared or digest_all:
        rows = rows.withColumn("_digest", digest).drop("_text")
    rows = rows.join(few.withColumn("_shared", F.lit(True)), ["_bytes", "_prefix"], "left")
    if "_digest" not in rows.columns:
        rows = rows.withColumn("_digest", F.when(F.col("_shared"), digest)).drop("_text")
    marked = stage(
        rows.select(
            "doc_id", "text_key", (F.col("_digest") if digest_all else F.when(F.col("_shared"), F.col("_digest"))).alias("text_sha256"), F.coalesce("_shared", F.lit(False)).alias("_shared"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "hashed",
    )
    crowd = marked.filter("_shared")
    first = stage(
        crowd.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "_row")).alias("_stays"), F.count(F.lit(1)).alias("group_size")
        ),
        "stays",
    )
    grouped = crowd.join(first, "text_sha256").select(
        "doc_id", F.col("_stays.doc_id").alias("keep_id"), "group_size",
        (F.col("_stays._row") == F.col("_row")).alias("kept"), "text_sha256", "text_key",
    )
    alone = marked.filter("not _shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "text_key",
    )
    return grouped.unionByName(alone)
