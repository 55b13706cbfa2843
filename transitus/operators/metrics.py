"""Reports over transitions, documents and reviews. Each returns a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import count_if, mean, n_rows, pct, total

ARROW = " → "


def transition_volume(transitions: DataFrame) -> DataFrame:
    """Volume, length of stay, cost and readmission share by path."""
    hits = count_if(F.col("readmitted"))
    return (
        transitions.filter(F.col("from_setting").isNotNull())
        .groupBy(F.concat("from_setting", F.lit(ARROW), "current_setting").alias("transition_path"))
        .agg(
            n_rows().alias("transition_count"),
            mean("length_of_stay").alias("avg_los_days"),
            mean("total_cost").alias("avg_cost"),
            hits.alias("readmissions"),
            F.round(pct(hits, n_rows()), 2).alias("readmission_rate_pct"),
        )
        .orderBy(F.desc_nulls_last("transition_count"), "transition_path")
    )


def risk_distribution(narratives: DataFrame) -> DataFrame:
    """Documents per tier with their share; the window runs over one row per tier."""
    counts = narratives.groupBy("risk_tier").agg(n_rows().alias("patient_count"))
    whole = Window.partitionBy(F.lit(1))
    return counts.withColumn("pct", F.round(pct(F.col("patient_count"), F.sum("patient_count").over(whole)), 1))


def tier_totals(narratives: DataFrame) -> DataFrame:
    tier = F.col("risk_tier")
    return narratives.agg(
        n_rows().alias("total"), count_if(tier == "HIGH").alias("high"),
        count_if(tier == "MEDIUM").alias("med"), count_if(tier == "LOW").alias("low"),
    )


def readmission_by_tier(narratives: DataFrame, transitions: DataFrame) -> DataFrame:
    hits = count_if(F.col("readmitted"))
    return (
        narratives.select("transition_id", "risk_tier")
        .join(transitions.select("transition_id", "readmitted"), "transition_id")
        .groupBy("risk_tier")
        .agg(n_rows().alias("transitions"), hits.alias("readmissions"),
             F.round(pct(hits, n_rows()), 2).alias("readmission_rate_pct"))
        .orderBy(F.desc_nulls_last("readmission_rate_pct"))
    )


def readmission_cost(transitions: DataFrame, encounters: DataFrame, saved_share: float = 0.20) -> DataFrame:
    """Cost of the encounters readmitted to, and what a cut by `saved_share` would save."""
    nxt = encounters.select(F.col("encounter_id").alias("next_encounter_id"), F.col("total_cost").alias("_cost"))
    return (
        transitions.filter("readmitted").select("next_encounter_id")
        .join(nxt, "next_encounter_id", "left")
        .agg(
            n_rows().alias("total_readmissions"),
            F.round(mean("_cost"), 2).alias("avg_readmission_cost"),
            F.round(total("_cost"), 2).alias("total_readmission_cost"),
            F.round(total("_cost") * F.lit(saved_share), 2).alias("potential_savings"),
        )
    )


def generation_stats(narratives: DataFrame, sections: list[str]) -> DataFrame:
    return narratives.agg(
        n_rows().alias("total_narratives"),
        F.min("generated_at").alias("earliest_generation"),
        F.max("generated_at").alias("latest_generation"),
        *[count_if(F.col(s).isNotNull()).alias(f"with_{s}") for s in sections],
    )


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(n_rows().alias("cnt"))


def readmission_rate(transitions: DataFrame) -> DataFrame:
    return transitions.agg(F.round(pct(count_if(F.col("readmitted")), n_rows()), 1).alias("rate"))


STATUS_ORDER = {"IN_REVIEW": 1, "DRAFT": 2, "REJECTED": 3}
TIER_ORDER = {"HIGH": 1, "MEDIUM": 2}


def _rank(c: str, order: dict[str, int]) -> Column:
    out = F
    for value, place in order.items():
        out = out.when(F.col(c) == value, place)
    return out.otherwise(max(order.values()) + 1)


def review_queue(
    state: DataFrame, narratives: DataFrame, cohort: DataFrame, transitions: DataFrame, status: str | None = None
) -> DataFrame:
    """Documents with patient and stay, those under review and of high risk first; `status` filters before the joins."""
    if status is not None:
        state = state.filter(F.col("status") == status)
    return (
        state.select("transition_id", "status", "assigned_to", "assigned_role", "assigned_at")
        .join(narratives.select("transition_id", "risk_tier"), "transition_id")
        .join(transitions.select("transition_id", "patient_id", "from_setting", "length_of_stay"), "transition_id")
        .join(cohort.select("patient_id", "patient_name", "age", "gender"), "patient_id")
        .orderBy(_rank("status", STATUS_ORDER), _rank("risk_tier", TIER_ORDER), "transition_id")
    )


def patient_list(narratives: DataFrame, transitions: DataFrame, cohort: DataFrame, state: DataFrame) -> DataFrame:
    """Documents newest first, with the approval status where there is one."""
    return (
        narratives.select("transition_id", "risk_tier", "generated_at")
        .join(transitions.select("transition_id", "patient_id"), "transition_id")
        .join(cohort.select("patient_id", "patient_name", "age", "gender"), "patient_id")
        .join(state.select("transition_id", F.col("status").alias("approval_status"), "assigned_to"), "transition_id", "left")
        .orderBy(F.desc_nulls_last("generated_at"), "transition_id")
    )


def narrative_detail(
    narratives: DataFrame, transitions: DataFrame, cohort: DataFrame, state: DataFrame, transition_id: int | None = None
) -> DataFrame:
    """Document with patient, stay and review; one transition if its id is given."""
    if transition_id is not None:
        narratives = narratives.filter(F.col("transition_id") == transition_id)
    stay = transitions.select(
        "transition_id", "patient_id", "from_setting", "admission_date", "discharge_date", "length_of_stay", "readmitted"
    )
    review = state.select("transition_id", F.col("status").alias("approval_status"), "reviewer_name", "approved_at")
    return (
        narratives.join(stay, "transition_id")
        .join(cohort.select("patient_id", "patient_name", "age", "gender"), "patient_id")
        .join(review, "transition_id", "left")
    )


def review_rates(state: DataFrame, edits: DataFrame) -> DataFrame:
    """Approval and rejection share and the number of edits, in one row."""
    status = F.col("status")
    marks = state.select(status, F.lit(0).alias("_edit")).unionAll(edits.select(F.lit(None).cast("string"), F.lit(1)))
    docs = count_if(F.col("_edit") == 0)
    return marks.agg(
        F.round(pct(count_if(status == "APPROVED"), docs), 1).alias("approval_rate"),
        F.round(pct(count_if(status == "REJECTED"), docs), 1).alias("rejection_rate"),
        count_if(F.col("_edit") == 1).alias("edits"),
    )


def readmission_with_document(transitions: DataFrame, narratives: DataFrame) -> DataFrame:
    """Readmission share of transitions with and without a document."""
    done = narratives.select("transition_id").distinct().withColumn("_has", F.lit(True))
    hits = count_if(F.col("readmitted"))
    return (
        transitions.select("transition_id", "readmitted").join(done, "transition_id", "left")
        .groupBy(F.coalesce("_has", F.lit(False)).alias("has_document"))
        .agg(n_rows().alias("transitions"), hits.alias("readmissions"), pct(hits, n_rows()).alias("readmission_rate_pct"))
    )


def facility_dashboard(transitions: DataFrame) -> DataFrame:
    """Transitions per facility and day, tier mix and share with a document."""
    tier = F.col("risk_tier")
    return transitions.groupBy("organization_id", F.to_date("admission_date").alias("day")).agg(
        n_rows().alias("transitions"),
        count_if(tier == "HIGH").alias("high"), count_if(tier == "MEDIUM").alias("medium"),
        count_if(tier == "LOW").alias("low"),
        pct(count_if(F.col("has_document")), n_rows()).alias("document_pct"),
    )


class MetricRegistry:
    """Named measures over one DataFrame, asked for by dimension."""

    def __init__(self, df: DataFrame, measures: dict[str, Column], dimensions: dict[str, Column]):
        self.df, self.measures, self.dimensions = df, measures, dimensions

    def ask(self, measures: list[str], by: list[str], where: Column | None = None) -> DataFrame:
        for name, known in [(m, self.measures) for m in measures] + [(d, self.dimensions) for d in by]:
            if name not in known:
                raise KeyError(f"{name!r} is not one of {sorted(known)}")
        df = self.df if where is None else self.df.filter(where)
        return df.groupBy(*[self.dimensions[d].alias(d) for d in by]).agg(
            *[self.measures[m].alias(m) for m in measures]
        )
