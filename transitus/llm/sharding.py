"""Contiguous shards of equal bytes, cut from global prefix sums that per-partition totals give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitus.llm.common import no_text, stage

GROUP = ["_hash", "size", "text_crc32"]


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the bytes of this partition that lie before each row."""
    carried = 0
    for rows in batches:
        total = rows["_bytes"].cumsum() + carried
        rows["_before"] = total - rows["_bytes"]
        carried = int(total.iloc[-1]) if len(rows) else carried
        yield rows


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's size is the UTF-8 bytes of its text plus 1. Equal texts are one group and stay in one shard.
    Groups are ordered by falling bytes, so that cuts fall between small ones; each shard is a contiguous run of
    that order, cut at equal byte targets. A group above the target cannot be cut without parting equal texts: it
    has a shard of its own, and the target is set anew for the rest (at most `shards` groups can be that large).
    `slot` numbers a shard's rows from 0. Null texts have no bytes; null or repeated doc_ids only share a place in
    the order. With fewer groups than shards some shards stay empty. An empty table gives an empty result.
    """
    text = no_text("text")
    rows = stage(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        ),
        "sizes",
    )
    groups = stage(rows.groupBy(*GROUP).agg(F.sum("size").alias("_bytes")), "groups")
    order = [F.desc("_bytes"), *GROUP]
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone, left = [], total
    for big in groups.orderBy(*order).limit(shards - 1).collect():  # at most one row for each shard
        if big["_bytes"] * (shards - len(alone)) <= left:
            break
        alone.append(big)
        left -= big["_bytes"]
    rest = shards - len(alone)
    lowest = alone[-1]["_bytes"] if alone else None
    ordered = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = stage(
        ordered.withColumn("_part", F.spark_partition_id()).mapInPandas(
            _running, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in groups.schema)}, _part int, _before bigint"
        ),
        "running",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row for each partition
        summed.groupBy("_part").agg(F.sum("_bytes").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    start = F.col("_before") + F.col("_offset") - F.lit(total - left)
    cut = F.expr(f"cast(_middle div {max(2 * left, 1)} as int)")
    own = F.lit(None).cast("int")
    for number, big in enumerate(alone):
        own = F.when(F.col("_hash") == big["_hash"], F.lit(number)).otherwise(own)
    placed = stage(
        summed.join(F.broadcast(offsets), "_part").withColumn("_middle", (2 * start + F.col("_bytes")) * rest).select(
            *GROUP, F.coalesce(
                F.when(F.col("_bytes") >= F.lit(lowest), own) if alone else own,
                F.lit(len(alone)) + F.greatest(F.lit(0), F.least(cut, F.lit(rest - 1))),
            ).alias("shard"),
        ),
        "placed",
    )
    line = ["shard", *GROUP, "doc_id"]
    numbered = stage(
        rows.join(placed, GROUP).repartitionByRange(*line).sortWithinPartitions(*line).select(
            "doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        ),
        "numbered",
    )
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (  # at most one row for each partition and shard
        numbered.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select("shard", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return numbered.join(F.broadcast(firsts), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_at") + F.col("_shift")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
