"""Medication reconciliation as joins with rule tables.

`held` tables are rows of (key, code, description, …), for example from `cohort.active_facts`. Pairs of drugs
are not listed: each drug that takes part in a finding has its own row, so results grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.functions.columns import n_rows, rules

# The combinations and classes always to be flagged.
INTERACTIONS = [
    ("anticoagulant+nsaid", "anticoagulant", "nsaid", "HIGH"),
    ("opioid+benzodiazepine", "opioid", "benzodiazepine", "HIGH"),
]
HIGH_ALERT = ["insulin", "anticoagulant", "opioid"]


def with_class(held: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Distinct drugs per key with their class."""
    return held.select(key, "code", "description").distinct().join(classes, "code")


def drug_interactions(
    held: DataFrame, classes: DataFrame, key: str, pairs: list[tuple[str, str, str, str]] = INTERACTIONS
) -> DataFrame:
    """(key, rule, severity, side, code, description): every drug on either side of a rule whose two sides are held.

    The sides must be held as two drugs: one drug is no finding, whether its class is on both sides or it has both.
    """
    sides = rules(
        held.sparkSession,
        [(r, c, side, sev) for r, a, b, sev in pairs for side, c in (("A", a), ("B", b))],
        "rule string, drug_class string, side string, severity string",
    )
    sided = with_class(held, classes, key).join(sides, "drug_class")
    both = (
        sided.groupBy(key, "rule").agg(
            F.min("side").alias("_a"), F.max("side").alias("_b"), F.min("code").alias("_c"), F.max("code").alias("_d")
        )
        .filter((F.col("_a") != F.col("_b")) & (F.col("_c") != F.col("_d"))).select(key, "rule")
    )
    return sided.join(both, [key, "rule"], "left_semi").select(key, "rule", "severity", "side", "code", "description")


def allergy_conflicts(held: DataFrame, allergies: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Held drugs whose class the patient is allergic to, with the number of such allergies."""
    hurt = (
        allergies.select(key, "code", "severity").join(classes, "code")
        .groupBy(key, "drug_class")
        .agg(n_rows().alias("n_allergies"), F.max("severity").alias("worst_severity"))
    )
    return with_class(held, classes, key).join(hurt, [key, "drug_class"])


def therapy_gaps(
    conditions: DataFrame, held: DataFrame, classes: DataFrame, groups: DataFrame,
    indications: list[tuple[str, str]], key: str,
) -> DataFrame:
    """Conditions with a known therapy but no held drug of any class indicated for them."""
    known = rules(conditions.sparkSession, indications, "category string, drug_class string")
    asked = (
        conditions.select(key, "code", "description").distinct()
        .join(groups.select("code", "category"), "code").join(known, "category")
    )
    have = with_class(held, classes, key).select(key, "drug_class").distinct()
    covered = asked.join(have, [key, "drug_class"], "left_semi").select(key, "code")
    return asked.select(key, "code", "description", "category").distinct().join(covered, [key, "code"], "left_anti")


def duplicate_therapy(held: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Drug classes held more than once, counted by distinct drug."""
    return (
        with_class(held, classes, key).groupBy(key, "drug_class").agg(n_rows().alias("n_drugs"))
        .filter(F.col("n_drugs") > 1)
    )


def high_alert_meds(held: DataFrame, classes: DataFrame, key: str, alert: list[str] = HIGH_ALERT) -> DataFrame:
    return with_class(held, classes, key).filter(F.col("drug_class").isin(*alert))


def meds_by_condition(held: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """Number of held drugs per reason, and whether the reason is among the patient's conditions."""
    listed = conditions.select(key, F.col("description").alias("reason")).distinct().withColumn("_listed", F.lit(True))
    return (
        held.select(key, "reason", "code").distinct().groupBy(key, "reason").agg(n_rows().alias("n_drugs"))
        .join(listed, [key, "reason"], "left")
        .withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed")
    )


def med_changes(held: DataFrame, transitions: DataFrame) -> DataFrame:
    """Drugs started and stopped during each stay; `held` comes from `cohort.active_facts`."""
    stays = transitions.select("transition_id", "admission_date", "discharge_date")
    started = F.col("start_at") >= F.col("admission_date")
    stopped = F.coalesce(F.col("stop_at") <= F.col("discharge_date"), F.lit(False))
    return held.join(stays, "transition_id").groupBy("transition_id").agg(
        F.count_if(started).cast("bigint").alias("started"),
        F.count_if(stopped).cast("bigint").alias("stopped"),
        F.count_if(~started & ~stopped).cast("bigint").alias("unchanged"),
    )
