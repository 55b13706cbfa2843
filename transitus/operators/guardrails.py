"""Checks before generation, checks of generated documents and monitoring thresholds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitus.functions.columns import days, rules
from transitus.functions.phrases import in_words, phrase_hits
from transitus.functions.text import any_like, sentences, word_count, words

# Phrases of the checks, word limits and thresholds.
DANGEROUS = ["%stop taking%", "%discontinue%immediately%", "%increase%dose%"]
REQUIRED = ["%diagnos%", "%medication%"]
UNCERTAIN = ["not sure", "might"]
WORD_LIMITS = {"clinical_handoff": 2000, "family_summary": 500}
SENTENCE_WORDS = 15
TARGETS = [
    ("hallucination_rate_pct", 2.0, 5.0, "pause generation"),
    ("edit_rate_pct", 30.0, 50.0, "retune prompts"),
    ("approval_hours", 4.0, 24.0, "staffing issue"),
]


def validate_profiles(
    profiles: DataFrame, cohort: DataFrame, as_of: date, reject_days: int = 30, warn_days: int = 14
) -> DataFrame:
    """Whether a document may be generated, with warnings; a profile of no known patient is rejected."""
    known = cohort.select("patient_id").distinct().withColumn("_known", F.lit(True))
    age = days(F.lit(as_of), "discharge_date")
    warnings = F.array_compact(F.array(
        F.when(F.col("n_medications") == 0, "NO_MEDICATIONS"),
        F.when(F.col("n_allergies") == 0, "NO_ALLERGIES_DOCUMENTED"),
        F.when(age > warn_days, "STALE_DATA"),
        F.when(F.col("discharge_date").isNull(), "OPEN_STAY"),
        F.when(F.col("_known").isNull(), "UNKNOWN_PATIENT"),
    ))
    valid = (F.col("n_conditions") > 0) & ~F.coalesce(age > reject_days, F.lit(False)) & F.col("_known").isNotNull()
    return profiles.join(known, "patient_id", "left").select(
        "transition_id", "patient_id", valid.alias("is_valid"), warnings.alias("warnings")
    )


def dictionary_table(spark: SparkSession, dictionary: DataFrame | list[str]) -> DataFrame:
    """(term): the terms in lower case, each once; a table may be of any size."""
    if isinstance(dictionary, DataFrame):
        return dictionary.select(F.lower(dictionary.columns[0]).alias("term")).distinct()
    return spark.createDataFrame([(t,) for t in sorted({t.lower() for t in dictionary})], "term string")


def mentioned_terms(documents: DataFrame, dictionary: DataFrame | list[str], text: str, key: str = "transition_id") -> DataFrame:
    """(key, term) for every dictionary phrase that occurs in the text, once each.

    `dictionary` is a table whose first column holds the terms, or a list. Terms and texts are compared by their words;
    what stands between them does not count. `key` must identify a document.
    """
    terms = dictionary_table(documents.sparkSession, dictionary).withColumn("_phrase", in_words(F.col("term")))
    tokens = documents.select(key, words(text).alias("_words"))
    return phrase_hits(tokens, [key], "_words", terms, "_phrase").select(key, "term").distinct()


def term_hallucination(
    documents: DataFrame, listed: DataFrame, dictionary: DataFrame | list[str], text: str, key: str = "transition_id"
) -> DataFrame:
    """Dictionary terms a document mentions though its patient's list does not hold them."""
    return mentioned_terms(documents, dictionary, text, key).join(
        listed.select(key, F.lower("term").alias("term")), [key, "term"], "left_anti"
    )


def dangerous_language(text: Column, patterns: list[str] = DANGEROUS) -> Column:
    return F.when(F.coalesce(any_like(text, patterns), F.lit(False)), "DANGEROUS_LANGUAGE").otherwise("PASS")


def completeness(
    text: Column, required: list[str] = REQUIRED, has_allergies: Column | None = None, allergy: str = "%allerg%"
) -> Column:
    """INCOMPLETE for a missing text, a missing section, or no allergy section where allergies are known."""
    full = F.lit(True)
    for pattern in required:
        full = full & text.ilike(pattern)
    if has_allergies is not None:
        full = full & (~has_allergies | text.ilike(allergy))
    return F.when(F.coalesce(full, F.lit(False)), "PASS").otherwise("INCOMPLETE")


def length_check(text: Column, limit: int) -> Column:
    return F.when(F.coalesce(word_count(text), F.lit(0)) < limit, "PASS").otherwise("TOO_LONG")


def longest_sentence(text: Column) -> Column:
    """Words in the longest sentence."""
    return F.coalesce(F.array_max(F.transform(sentences(text), lambda s: word_count(s))), F.lit(0)).cast("bigint")


def uncertainty(text: Column, markers: list[str] = UNCERTAIN) -> Column:
    pattern = r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(markers) + r")($|[^\p{L}\p{N}])"
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), "UNCERTAIN").otherwise("PASS")


def quality_checks(
    documents: DataFrame, listed: DataFrame, dictionary: DataFrame | list[str], text: str = "clinical_handoff",
    allergies: DataFrame | None = None, limit: int = WORD_LIMITS["clinical_handoff"],
    dangerous: list[str] = DANGEROUS, required: list[str] = REQUIRED, uncertain: list[str] = UNCERTAIN,
) -> DataFrame:
    """All checks of one document text, the verdict and what to do.

    `allergies` is (transition_id, n_allergies); where given, a document must speak of known allergies.
    """
    wrong = (
        term_hallucination(documents, listed, dictionary, text)
        .groupBy("transition_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_unlisted"))
    )
    t = F.col(text)
    rows = documents.join(wrong, "transition_id", "left")
    has = None
    if allergies is not None:
        rows = rows.join(allergies.select("transition_id", "n_allergies"), "transition_id", "left")
        has = F.coalesce(F.col("n_allergies") > 0, F.lit(False))
    checks = rows.select(
        "transition_id", F.coalesce("n_unlisted", F.lit(0)).cast("bigint").alias("n_unlisted"),
        F.when(F.col("n_unlisted") > 0, "HALLUCINATED").otherwise("PASS").alias("hallucination_check"),
        dangerous_language(t, dangerous).alias("safety_language_check"),
        completeness(t, required, has).alias("completeness_check"),
        length_check(t, limit).alias("length_check"),
        uncertainty(t, uncertain).alias("uncertainty_check"),
    )
    action = (
        F.when(F.col("safety_language_check") != "PASS", "BLOCK_PHARMACIST_REVIEW")
        .when(F.col("hallucination_check") != "PASS", "INVALID_HUMAN_REVIEW")
        .when(F.col("completeness_check") != "PASS", "MARK_INCOMPLETE")
        .when(F.col("length_check") != "PASS", "REGENERATE")
        .when(F.col("uncertainty_check") != "PASS", "PHYSICIAN_REVIEW")
        .otherwise("NONE")
    )
    return checks.withColumn("action", action).withColumn(
        "verdict", F.when(F.col("action") == "NONE", "PASSED").otherwise("FAILED")
    )


def monitor_thresholds(metrics: DataFrame, targets: list[tuple[str, float, float, str]] = TARGETS) -> DataFrame:
    """(metric, value) against target and alert level; a null value has no status."""
    table = rules(metrics.sparkSession, targets, "metric string, target double, alert double, action string")
    value = F.col("value")
    status = F.when(value > F.col("alert"), "ALERT").when(value >= F.col("target"), "ABOVE_TARGET").when(value.isNotNull(), "OK")
    return metrics.join(table, "metric").select(
        "metric", "value", status.alias("status"), F.when(status == "ALERT", F.col("action")).alias("action")
    )
