"""Summaries, document search and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import n_rows
from transitus.functions.skew import HOT_ROWS, heaviest, salted_join
from transitus.functions.text import SENTENCE_END, words
from transitus.operators.search_index import SearchIndex
from transitus.operators.vectors import build, search
from transitus.session import shared_folder, stage

WEIGHT = "decimal(20,6)"
# Words whose weights are broadcast: some 20 MB in each executor.
HELD_WORDS = 200_000


def summarize_history(docs: DataFrame, k: int, key: str, text: str = "text", min_rows: int = HOT_ROWS, held: int = HELD_WORDS) -> DataFrame:
    """The `k` sentences of each document with the highest mean inverse document frequency of their words.

    Weights are rounded to six places as decimals, so their sums do not depend on row order. Those of the `held` most
    frequent words are broadcast, so that their tokens are summed where they are read; only tokens of other words move.
    """
    # outer forms, as a filter inferred for the others would cut each text twice
    split = docs.select(key, F.posexplode_outer(F.split(text, SENTENCE_END)).alias("position", "sentence"))
    parsed = split.select(key, "position", F.array_distinct(words("sentence")).alias("_words"))
    tokens = parsed.select(key, "position", F.size("_words").alias("_len"), F.explode_outer("_words").alias("word")).filter(F.col("word").isNotNull())
    told = docs.select(F.explode_outer(F.array_distinct(words(text))).alias("word")).filter(F.col("word").isNotNull())
    total = docs.agg(n_rows()).scalar()
    idf = F.round(F.log(total.cast("double") / F.col("_df").cast("double")), 6).cast(WEIGHT).alias("_w")
    weights = stage(told.groupBy("word").agg(n_rows().alias("_df")).select("word", "_df", idf), "word-weights")
    if weights.count() <= held:
        scored = tokens.join(F.broadcast(weights.select("word", "_w")), "word")
    else:
        frequent = F.broadcast(stage(weights.orderBy(F.desc("_df"), "word").limit(held), "frequent-words").select("word", "_w"))
        others = weights.join(frequent, "word", "left_anti")
        # words of many documents are also the ones with many tokens
        hot = heaviest(others, "word", "_df", max(1, min_rows // 10))
        rest = salted_join(tokens.join(frequent, "word", "left_anti"), others.select("word", "_w"), "word", hot, [key, "position"])
        scored = tokens.join(frequent, "word").unionByName(rest)
    best = Window.partitionBy(key).orderBy(F.desc("score"), "position")
    ranked = (
        scored.groupBy(key, "position", "_len").agg(F.sum("_w").alias("_s"))
        .withColumn("score", F.col("_s").cast("double") / F.col("_len").cast("double"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    )
    # at most k of a key; the whole text is sent to them, once, and cut there
    chosen = ranked.groupBy(key).agg(F.collect_list(F.struct("rank", "position", "score")).alias("_chosen"))
    parts = docs.select(key, text).join(chosen, key).select(key, F.split(text, SENTENCE_END).alias("_parts"), F.explode_outer("_chosen").alias("_at"))
    out = parts.select(key, "_at.rank", "_at.position", "_at.score", F.trim(F.get("_parts", F.col("_at.position"))).alias("sentence"))
    return out.filter(F.size(words("sentence")) > 0)


def search_docs(
    docs: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, text: str = "text",
    common_share: float = 0.1, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Best `k` documents per query by BM25, exact: an index of the words that are asked for, searched once.

    For a corpus that is searched again, keep a `search_index.SearchIndex`.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    index = SearchIndex(spark, folder, key, dict(docs.dtypes)[key], buckets=1)
    index.add(docs, text, only=queries.select(F.explode(F.array_distinct(words(text))).alias("word")))
    return index.search(queries, k, query_key, text, common_share, min_rows)


def similar_vectors(
    vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding"
) -> DataFrame:
    """The `k` vectors of highest cosine per query vector, exact: an index built, searched once and given up."""
    return search(build(vectors, key, vector), queries, k, query_key, vector)


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per label, summed element by element so that no label is gathered in one task."""
    parts = vectors.select(label, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(label).agg(F.transform(ordered, lambda p: p["_m"]).alias(vector))
