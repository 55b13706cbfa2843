"""Cohort, transitions and clinical state."""

from pyspark.sql import functions as F

from transitus.operators import cohort, metrics
from transitus.plans.registry import query
from transitus.sources.binding import FOCUS, READMIT

DAY = "yyyy-MM-dd"


def day(c):
    return F.date_format(c, DAY).alias(c)


@query("patient_cohort", "cohort", """
    SELECT patient_id, patient_name, gender, state, age, total_stays, strftime(first_admission, '%Y-%m-%d') AS first_admission,
           strftime(last_admission, '%Y-%m-%d') AS last_admission, avg_los_days, total_cost FROM cohort""")
def patient_cohort(t):
    return t.cohort.select(
        "patient_id", "patient_name", "gender", "state", "age", "total_stays", day("first_admission"),
        day("last_admission"), "avg_los_days", "total_cost",
    )


@query("encounter_sequence", "seq", """
    SELECT encounter_id, patient_id, encounter_class, prev_encounter_id, prev_setting,
           strftime(prev_discharge, '%Y-%m-%d') AS prev_discharge, next_encounter_id, next_setting,
           strftime(next_admission, '%Y-%m-%d') AS next_admission FROM seq""")
def encounter_sequence(t):
    return t.sequence.select(
        "encounter_id", "patient_id", "encounter_class", "prev_encounter_id", "prev_setting", day("prev_discharge"),
        "next_encounter_id", "next_setting", day("next_admission"),
    )


@query("care_transitions", "trans", """
    SELECT transition_id, patient_id, encounter_id, current_setting, strftime(admission_date, '%Y-%m-%d') AS admission_date,
           strftime(discharge_date, '%Y-%m-%d') AS discharge_date, length_of_stay, total_cost::DOUBLE AS total_cost,
           from_setting, days_between_settings, to_setting, days_to_next_encounter, readmitted FROM trans""")
def care_transitions(t):
    return t.transitions.select(
        "transition_id", "patient_id", "encounter_id", "current_setting", day("admission_date"), day("discharge_date"),
        "length_of_stay", F.col("total_cost").cast("double").alias("total_cost"), "from_setting",
        "days_between_settings", "to_setting", "days_to_next_encounter", "readmitted",
    )


@query("care_transitions_any_within", "enc", """
    SELECT e.encounter_id, e.patient_id, EXISTS (
        SELECT 1 FROM enc n WHERE n.patient_id = e.patient_id AND n.encounter_class IN ('inpatient', 'emergency')
           AND date_diff('day', e.stop_at, n.start_at) BETWEEN 0 AND 30) AS readmitted
    FROM enc e WHERE e.encounter_class = 'snf'""")
def care_transitions_any_within(t):
    return cohort.care_transitions(t.sequence, FOCUS, READMIT, mode="any_within", ids="hash").select(
        "encounter_id", "patient_id", "readmitted"
    )


@query("active_conditions", "actcond", """
    SELECT transition_id, patient_id, code, count(*)::BIGINT AS n FROM actcond GROUP BY ALL""")
def active_conditions(t):
    return (
        cohort.active_facts(t.transitions, t.conditions)
        .groupBy("transition_id", "patient_id", "code").agg(F.count("*").alias("n"))
    )


@query("transition_profile_counts", "prof", """
    SELECT transition_id, patient_id, readmitted, n_conditions, n_medications, n_allergies FROM prof""")
def transition_profile_counts(t):
    return t.profile_counts.select(
        "transition_id", "patient_id", "readmitted", "n_conditions", "n_medications", "n_allergies"
    )


@query("transition_profiles", "prof actcond actmed", """
    SELECT p.transition_id, 0 AS part, p.n_conditions AS conditions, p.n_medications AS medications, p.n_allergies AS allergies,
           c.first_code, m.last_reason
    FROM prof p LEFT JOIN (SELECT transition_id, min(code) AS first_code FROM actcond GROUP BY 1) c USING (transition_id)
    LEFT JOIN (SELECT transition_id, max(reason) AS last_reason FROM actmed GROUP BY 1) m USING (transition_id)""")
def transition_profiles(t):
    def held(name):
        return F.aggregate(name, F.lit(0).cast("bigint"), lambda n, x: n + x["copies"])

    return cohort.transition_profiles(t.transitions, t.conditions, t.medications, t.allergies, together=t.clinical).select(
        "transition_id", "part", held("active_conditions").alias("conditions"),
        held("active_medications").alias("medications"), held("allergies").alias("allergies"),
        F.array_min(F.transform("active_conditions", lambda x: x["code"])).alias("first_code"),
        F.array_max(F.transform("active_medications", lambda x: x["reason"])).alias("last_reason"),
    )


@query("recent_observations", "trans obs", """
    WITH hit AS (
      SELECT t.transition_id, o.vital, o.value, o.observed_at,
             row_number() OVER (PARTITION BY t.transition_id, o.vital
                                ORDER BY o.observed_at DESC, o.observation_id DESC, o.value DESC) AS rn,
             count(*) OVER (PARTITION BY t.transition_id, o.vital) AS n
      FROM trans t JOIN obs o ON o.patient_id = t.patient_id AND o.observed_at <= t.discharge_date)
    SELECT transition_id, vital, value::BIGINT AS last_value, strftime(observed_at, '%Y-%m-%d') AS observed_at,
           n::BIGINT AS n_readings FROM hit WHERE rn = 1""")
def recent_observations(t):
    return cohort.recent_observations(t.transitions, t.observations).withColumn("observed_at", day("observed_at"))


@query("encounter_timeline", "enc", """
    SELECT patient_id, encounter_id, encounter_class,
           row_number() OVER (PARTITION BY patient_id ORDER BY start_at, encounter_id)::BIGINT AS position FROM enc""")
def encounter_timeline(t):
    return cohort.encounter_timeline(t.encounters).select("patient_id", "encounter_id", "encounter_class", "position")


@query("timeline_pages", "enc", """
    WITH p AS (SELECT patient_id, encounter_id,
                      (row_number() OVER (PARTITION BY patient_id ORDER BY start_at, encounter_id) - 1) // 8 AS page FROM enc)
    SELECT patient_id, page::INT AS page, count(*)::INT AS entries FROM p GROUP BY ALL""")
def timeline_pages(t):
    return cohort.timeline_pages(t.encounters, page_size=8).select(
        "patient_id", "page", F.size("timeline").alias("entries")
    )


@query("prior_readmissions", "trans", """
    SELECT transition_id, patient_id, count(*) OVER w::BIGINT AS prior_stays,
           coalesce(sum(readmitted::INT) OVER w, 0)::BIGINT AS prior_readmissions
    FROM trans WINDOW w AS (PARTITION BY patient_id ORDER BY admission_date, encounter_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_readmissions(t):
    return cohort.prior_readmissions(t.transitions).select(
        "transition_id", "patient_id", "prior_stays", "prior_readmissions"
    )


@query("transition_volume", "trans", """
    SELECT from_setting || ' → ' || current_setting AS transition_path, count(*)::BIGINT AS transition_count,
           sum(length_of_stay)::DOUBLE / nullif(count(length_of_stay), 0)::DOUBLE AS avg_los_days,
           sum(total_cost)::DOUBLE / count(*)::DOUBLE AS avg_cost, count_if(readmitted)::BIGINT AS readmissions,
           round(count_if(readmitted)::DOUBLE * 100.0 / count(*)::DOUBLE, 2) AS readmission_rate_pct
    FROM trans WHERE from_setting IS NOT NULL GROUP BY 1 ORDER BY 2 DESC""")
def transition_volume(t):
    return metrics.transition_volume(t.transitions)
