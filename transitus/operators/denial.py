"""Claim denials, revenue at risk and facility comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.functions.columns import count_if, days, mean, n_rows, pct, rules, total
from transitus.operators.narrative import fill

DENIED_AFTER_DAYS = 60
# Tasks that claim lines are dealt over where an encounter has about as many groups as lines. Up to 200
# (spark.shuffle.sort.bypassMergeThreshold) rows go to files as they come; beyond, the dealing task would sort them in memory.
TASKS = 192


def payment_status(outstanding: Column, waited: Column, after_days: int = DENIED_AFTER_DAYS) -> Column:
    """Unpaid and billed long after service means likely denied; no amount known means paid."""
    unpaid = outstanding > 0
    return F.when(unpaid & (waited > after_days), "LIKELY_DENIED").when(unpaid, "PENDING").otherwise("PAID")


def infer_payment_status(
    claims: DataFrame, encounters: DataFrame, payers: DataFrame, focus: str | None = None,
    after_days: int = DENIED_AFTER_DAYS,
) -> DataFrame:
    """Claim lines with payer, days from service to billing, and the status they suggest."""
    stays = encounters if focus is None else encounters.filter(F.col("encounter_class") == focus)
    waited = days("billed_at", "service_at")
    return (
        claims.join(stays.select("encounter_id", "encounter_class", "payer"), "encounter_id")
        .join(payers.select("payer"), "payer")
        .withColumn("days_to_payment", waited)
        .withColumn("payment_status", payment_status(F.col("outstanding"), waited, after_days))
    )


def denial_rate_by_payer(lines: DataFrame) -> DataFrame:
    denied = count_if(F.col("payment_status") == "LIKELY_DENIED")
    return (
        lines.groupBy("payer").agg(n_rows().alias("lines"), denied.alias("denied"), pct(denied, n_rows()).alias("denial_rate_pct"))
        .orderBy(F.desc_nulls_last("denial_rate_pct"), "payer")
    )


def denial_risk(
    claims: DataFrame, encounters: DataFrame, by: list[str], after_days: int = DENIED_AFTER_DAYS, tasks: int = TASKS
) -> DataFrame:
    """Per group of `by`: encounters, charges, unpaid amount, share of encounters and of lines denied.

    Lines are summed per encounter before the join with encounters, so an encounter with very many lines is
    one row there. Where `by` names columns of the lines, summing merges few of them; the lines are then dealt over
    `tasks` tasks of their own first, so that no task holds the sums beside the sorted sides of both joins.
    """
    own = [c for c in by if c in claims.columns]
    denied = payment_status(F.col("outstanding"), days("billed_at", "service_at"), after_days) == "LIKELY_DENIED"
    lines = claims.select("encounter_id", *own, denied.alias("_is_denied"), "charge", "outstanding")
    if own:
        lines = lines.repartition(tasks, "encounter_id", *own)
    per_encounter = lines.groupBy("encounter_id", *own).agg(
        n_rows().alias("_lines"), F.count_if("_is_denied").alias("_denied"),
        F.sum("charge").alias("_charge"), F.sum("outstanding").alias("_unpaid"),
    )
    joined = per_encounter.join(encounters.select("encounter_id", *[c for c in by if c not in own]), "encounter_id")
    return joined.groupBy(*by).agg(
        n_rows().alias("total_encounters"),
        pct(count_if(F.col("_denied") > 0), n_rows()).alias("denial_rate_pct"),
        total("_charge").alias("total_charged"),
        total("_unpaid").alias("total_outstanding"),
        pct(F.sum("_denied"), F.sum("_lines")).alias("pct_lines_denied"),
    )


def revenue_at_risk(risk: DataFrame, divisor: float = 10_000.0, uninsured: str = "NO_INSURANCE") -> DataFrame:
    """Estimated denials per group.

    A percentage times dollars needs a divisor of 100; the usual 10,000 yields a hundredth of that, which fits
    amounts in cents. Both are given: `estimated_denials` with `divisor`, `denied_dollars` with 100.
    """
    product = F.col("denial_rate_pct") * F.col("total_charged")
    return (
        risk.filter(F.col("payer") != uninsured)
        .select(
            *[c for c in ("payer", "diagnosis") if c in risk.columns], "total_encounters",
            F.round(product / F.lit(divisor), 0).alias("estimated_denials"),
            F.round(product / F.lit(100.0), 0).alias("denied_dollars"), "pct_lines_denied",
            F.round("total_outstanding", 0).alias("current_outstanding"),
        )
        .orderBy(F.desc_nulls_last("estimated_denials"))
    )


def denial_by_day_of_stay(lines: DataFrame, encounters: DataFrame, at: str, edges: list[int]) -> DataFrame:
    """Share of denied lines per payer and range of days since admission; `edges` start the ranges."""
    stays = encounters.select("encounter_id", F.col("start_at").alias("_admitted"))
    day = days(at, "_admitted")
    bucket = F.when(day < edges[0], F.lit(-1))
    for place, upper in enumerate(edges[1:]):
        bucket = bucket.when(day < upper, F.lit(edges[place]))
    denied = count_if(F.col("payment_status") == "LIKELY_DENIED")
    return (
        lines.join(stays, "encounter_id")
        .groupBy("payer", bucket.otherwise(F.lit(edges[-1])).cast("bigint").alias("from_day"))
        .agg(n_rows().alias("lines"), denied.alias("denied"), pct(denied, n_rows()).alias("denial_rate_pct"))
    )


def active_denial_alerts(
    encounters: DataFrame, alert_rules: list[tuple[str, int, int, str]], as_of: date
) -> DataFrame:
    """Open stays whose day of stay lies in a rule (payer, from day, to day, action) of their payer."""
    table = rules(encounters.sparkSession, alert_rules, "payer string, from_day int, to_day int, alert string")
    stays = encounters.filter(F.col("stop_at").isNull() & (F.to_date("start_at") <= F.lit(as_of))).withColumn(
        "day_of_stay", days(F.lit(as_of), "start_at")
    )
    return stays.join(table, "payer").filter(F.col("day_of_stay").between(F.col("from_day"), F.col("to_day"))).select(
        "encounter_id", "patient_id", "payer", "day_of_stay", "alert",
        (F.col("to_day") - F.col("day_of_stay")).cast("bigint").alias("days_left"),
    )


LETTER = (
    "Write a continued stay review of about 200 words that justifies the stay to the payer.\n"
    "Patient: {patient_name} ({payer}). Day of stay: {day_of_stay}. Diagnosis: {diagnosis}. Situation: {alert}."
)


def denial_letter_prompts(alerts: DataFrame, patients: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """One prompt per alert; `diagnoses` is (patient_id, diagnosis)."""
    rows = alerts.join(patients.select("patient_id", "patient_name"), "patient_id", "left").join(
        diagnoses.select("patient_id", "diagnosis"), "patient_id", "left"
    )
    return rows.withColumn("day_of_stay", F.col("day_of_stay").cast("string")).select(
        "encounter_id", F.lit("denial_letter").alias("section"), fill(LETTER, {}).alias("prompt")
    )


# Cut-offs of the scorecard are ours.
GRADES = [(20.0, "ACCEPT"), (50.0, "REVIEW")]


def referral_scorecard(risk: DataFrame, encounters: DataFrame, focus: str) -> DataFrame:
    """Per payer: denial share, stay cost and length, revenue to expect, and a grade. The columns are our choice."""
    stays = encounters.filter(F.col("encounter_class") == focus).groupBy("payer").agg(
        n_rows().alias("stays"), mean("total_cost").alias("avg_stay_cost"), mean(days("stop_at", "start_at")).alias("avg_los_days")
    )
    grade = F
    for limit, name in GRADES:
        grade = grade.when(F.col("denial_rate_pct") < limit, name)
    return risk.select("payer", "denial_rate_pct", "total_outstanding").join(stays, "payer").select(
        "payer", "stays", "denial_rate_pct", "avg_stay_cost", "avg_los_days", "total_outstanding",
        (F.col("avg_stay_cost") * (F.lit(1.0) - F.col("denial_rate_pct") / F.lit(100.0))).alias("expected_revenue"),
        grade.otherwise("CAUTION").alias("grade"),
    )


def state_benchmarks(ratings: DataFrame, k: int = 20) -> DataFrame:
    """The `k` states with the most payment denials."""
    return (
        ratings.groupBy("state")
        .agg(
            n_rows().alias("facilities"), F.round(mean("overall_rating"), 1).alias("avg_stars"),
            F.round(mean("payment_denials"), 2).alias("avg_denials"),
            F.sum("payment_denials").cast("bigint").alias("total_denials"),
        )
        .orderBy(F.desc_nulls_last("total_denials"), "state").limit(k)
    )


def appeal_success(lines: DataFrame, by: list[str], after_days: int = DENIED_AFTER_DAYS) -> DataFrame:
    """Of the lines billed again long after service, the share that was paid in the end."""
    won = count_if(F.col("outstanding") <= 0)
    return lines.filter(F.col("days_to_payment") > after_days).groupBy(*by).agg(
        n_rows().alias("denials"), won.alias("overturned"), pct(won, n_rows()).alias("overturn_rate_pct")
    )


def facility_benchmark(transitions: DataFrame, facilities: DataFrame) -> DataFrame:
    """Each facility against its market: length of stay and readmission share, with the differences."""
    sums = transitions.groupBy("organization_id").agg(
        n_rows().alias("_n"), F.sum("length_of_stay").alias("_days"), F.count("length_of_stay").alias("_closed"),
        F.count_if(F.col("readmitted")).alias("_hits"),
    ).join(facilities.select("organization_id", "facility", "chain"), "organization_id")
    market = sums.groupBy("chain").agg(
        (F.sum("_days").cast("double") / F.sum("_closed").cast("double")).alias("market_los"),
        pct(F.sum("_hits"), F.sum("_n")).alias("market_readmission_pct"),
    )
    los = F.col("_days").cast("double") / F.col("_closed").cast("double")
    hit = pct(F.col("_hits"), F.col("_n"))
    return sums.join(market, "chain").select(
        "organization_id", "facility", "chain", F.col("_n").alias("stays"), los.alias("avg_los"), hit.alias("readmission_pct"),
        (los - F.col("market_los")).alias("los_delta"), (hit - F.col("market_readmission_pct")).alias("readmission_delta"),
    )
