"""The registered queries of this package: operators with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitus.llm import (
    bpe, context_tree, decontaminate, exact_dedup, fill_in_middle, html_text, language_id, near_dedup, sharding, spelling, substring_dedup,
    suffix_dedup, warc,
)
from transitus.llm.common import table
from transitus.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"), 16)


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    coded = bpe.round_trip(spark, F.col("text"), vocabulary_path())
    return docs.select("doc_id", coded.alias("_coded")).select("doc_id", "_coded.*")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_earlier(table(spark, folder, "documents"), 50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_dedup(table(spark, folder, "documents"), near_dedup.Forest(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_id(table(spark, folder, "documents"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


def op12_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score_texts(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), drop_every=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_suffix_dedup, op3_warc, op4_sharding, op5_bpe, op6_substring_dedup, op7_html_text, op8_exact_dedup,
        op9_near_dedup, op10_language_id, op11_fill_in_middle, op12_context_tree, op13_spelling,
    )
}
