"""Text helpers on built-in expressions; whole texts, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[.!?\n]+"


def words(text: Column | str) -> Column:
    """Lower-case words: maximal runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def with_word_counts(df: DataFrame, text: Column) -> DataFrame:
    """One row per distinct word of a row's text, with `word`, its occurrences `_tf` and the number of all words `_dl`.

    Counted within the row, on its sorted words: nothing is shuffled and no text is compared with another. The other
    columns of `df` are kept; a text without words gives no row.
    """
    place = F.sequence(F.lit(0), F.greatest(F.size("_sorted") - 1, F.lit(0)))
    first = F.filter(place, lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    run = lambda i, at: F.struct(
        F.get("_sorted", i).alias("word"), (F.coalesce(F.get("_first", at + 1), F.size("_sorted")) - i).cast("bigint").alias("_tf")
    )
    parsed = df.withColumn("_sorted", F.sort_array(words(text))).withColumn("_first", first)
    # the outer form, as a test for empty arrays would be pushed down and cut each text into words once more
    return parsed.select(*df.columns, F.size("_sorted").alias("_dl"), F.inline_outer(F.transform("_first", run))).filter("word IS NOT NULL")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint")


def sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def any_like(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.ilike(p)
    return out
