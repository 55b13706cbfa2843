"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import Shipped

# A classifier is fitted on about so many labelled documents of each language, chosen by a hash of their id.
SAMPLE_DOCS = 2_000
BUCKETS = 1 << 13
SIZES = (1, 2, 3)
UNKNOWN = "und"
# A prediction is ambiguous when the nearest codeword is not this many times as likely as the next one.
MARGIN = 2.0
PREDICTED = "lang_pred string, score double, ambiguous boolean"


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str, letters: np.ndarray) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of lower-case letters, runs of other characters being one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = letters[points]
    if not letter.any():
        return np.zeros(0)
    points = np.where(letter, points, 32).astype(np.uint64)
    gap = points == 32
    points = np.concatenate(([32], points[~(gap & np.concatenate(([False], gap[:-1])))], [32])).astype(np.uint64)
    counts = np.zeros(BUCKETS)
    mixed = np.zeros(len(points), dtype=np.uint64)
    for size in range(1, max(SIZES) + 1):
        tail = points[size - 1 :]
        mixed = (mixed[: len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
        if size in SIZES:
            counts += np.bincount((mixed >> np.uint64(40)) % np.uint64(BUCKETS), minlength=BUCKETS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language.

    Up to seven languages: every split of them into two sides once. More: rows of a Hadamard matrix, any two of
    which differ in half of their bits.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        splits = [s for s in product((1, -1), repeat=languages - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], dtype=float).T
    matrix = np.ones((1, 1))
    while len(matrix) <= languages:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[1 : languages + 1, 1:]


class LanguageModel:
    """One linear n-gram classifier for each bit of the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> None:
        self.languages, self.code, self.letters = languages, codewords(len(languages)), letter_table()
        share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        self.weights = np.zeros((self.code.shape[1], BUCKETS))
        for bit, column in enumerate(self.code.T):
            if (column < 0).any():
                self.weights[bit] = np.log(share[column > 0].mean(axis=0) / share[column < 0].mean(axis=0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        grams = features(text or "", self.letters)
        if not grams.size or not self.languages:
            return UNKNOWN, 0.0, True
        # the mean vote of the n-grams of a classifier, its scale growing slowly with what there is to read
        total = grams.sum()
        votes = self.weights @ grams / total * np.sqrt(min(total, 400.0))
        losses = np.logaddexp(0.0, -self.code * votes).sum(axis=1)
        likely = np.exp(losses.min() - losses)
        likely /= likely.sum()
        best = int(likely.argmax())
        second = np.partition(likely, -2)[-2] if len(likely) > 1 else 0.0
        return self.languages[best], float(likely[best]), bool(likely[best] < MARGIN * second)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns from the rows of `docs` (doc_id, text, lang) whose lang is not null.

    About `sample` documents of each language, whole texts, are read; their n-gram counts are added up by
    language in Spark, so that the driver gets one vector for each language. Null texts add nothing. With no
    labelled row the model predicts `und` for everything.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    picked = F.lit(False)
    spread = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    for lang, size in sizes.items():
        picked |= (F.col("lang") == lang) & (spread < min(1.0, sample / size) * 1_000_000)

    letters = Shipped(docs.sparkSession, letter_table())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                if (grams := features(text or "", letters.get())).size:
                    sums[lang] = sums.get(lang, 0) + grams
        for lang, grams in sums.items():
            (bucket,) = grams.nonzero()
            yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": grams[bucket]})

    counts = {lang: np.zeros(BUCKETS) for lang in sorted(sizes)}
    counted = labelled.filter(picked).select("lang", "text").mapInPandas(count, "lang string, bucket int, n double")
    # languages x buckets, not by toLocalIterator: shuffle files may be cleaned up before it has read them
    for row in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["lang"]][row["bucket"]] = row["n"]
    return LanguageModel(list(counts), np.array(list(counts.values())))


def predictor(docs: DataFrame, model: LanguageModel):
    """A function from a text column to a struct of `PREDICTED`.

    `und` with score 0 and ambiguous for texts that are null or have no letter.
    """
    held = Shipped(docs.sparkSession, model)

    @F.pandas_udf(PREDICTED)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.get().predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, ambiguous; trained on what is not held out.

    A null doc_id is not held out. Ambiguous rows keep their nearest language and are flagged.
    """
    model = train(docs.filter(~held_out()))
    guess = predictor(docs, model)(F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), guess.alias("_guess")).select("doc_id", "held_out", "_guess.*")
