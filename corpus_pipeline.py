"""From raw documents to tokens: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitus.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from transitus.llm.common import drop_rows, prepared, table
from transitus.llm.queries import vocabulary_path
from transitus.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (`und`) go; the others go on, flagged in `language_ambiguous` if no language is clear.

    The model learns from the labelled documents of this stage that are not held out. If there are none, no
    language is clear, and every document with a letter goes on.
    """
    prepared(spark)
    model = language_id.train(docs.filter(~language_id.held_out()))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("language_ambiguous", F.lit(True))
    # not deterministic: otherwise the filter would predict a second time
    guess = language_id.predictor(docs, model).asNondeterministic()
    told = docs.withColumn("_guess", guess(F.col("text"))).filter(F.col("_guess")["score"] > 0)
    return told.withColumn("language_ambiguous", F.col("_guess")["ambiguous"]).drop("_guess")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id goes on."""
    prepared(spark)
    return drop_rows(docs, exact_dedup.exact_dedup(docs))


def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over shingles of five words one goes on, the smallest doc_id."""
    prepared(spark)
    return drop_rows(docs, near_dedup.near_dedup(docs, near_dedup.Forest(shingle=5, percent=80)))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: a twentieth of their words or more lies in windows of test items."""
    benchmark = table(spark, sf_dir, "benchmark")
    hits = decontaminate.item_hits(F.col("text"), benchmark)
    return docs.filter(~decontaminate.contaminated(hits))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, with digests of its ids and of the text decoded from them."""
    prepared(spark)
    coded = bpe.round_trip(spark, F.col("text"), vocabulary_path(), with_ids=True)
    return docs.select("doc_id", coded.alias("_coded")).select("doc_id", "_coded.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", dissimilar_texts),
    ("benchmark", clean_of_benchmark),
    ("tokens", tokens),
]

#: Language identification is a trained model and BPE a loop: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, step) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        step(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
