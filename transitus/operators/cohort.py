"""Cohort, encounter sequence, care transitions and the clinical state at each transition."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import age_years, days, mean, n_rows, total
from transitus.functions.skew import HOT_ROWS, HOT_STAYS, dense_ids, interval_join, neighbours, overlap_counts, running_sums
from transitus.session import stage


def patient_cohort(
    patients: DataFrame, encounters: DataFrame, focus: str, as_of: date, exact_age: bool = False
) -> DataFrame:
    """Patients with at least one encounter of class `focus`, with their stay summary.

    Encounters are summed per patient before the join, so the join carries one row per patient.
    """
    stays = (
        encounters.filter(F.col("encounter_class") == focus)
        .groupBy("patient_id")
        .agg(
            F.count_distinct("encounter_id").cast("bigint").alias("total_stays"),
            F.min("start_at").alias("first_admission"),
            F.max("start_at").alias("last_admission"),
            mean(days("stop_at", "start_at")).alias("avg_los_days"),
            total("total_cost").alias("total_cost"),
        )
    )
    return patients.withColumn("age", age_years(F.col("birthdate"), F.lit(as_of), exact_age)).join(stays, "patient_id")


def cohort_ids(encounters: DataFrame, focus: str) -> DataFrame:
    return encounters.filter(F.col("encounter_class") == focus).select("patient_id").distinct()


def encounter_sequence(
    encounters: DataFrame, cohort: DataFrame, settings: Sequence[str], min_rows: int = HOT_ROWS
) -> DataFrame:
    """Previous and next encounter of each cohort patient, ordered by start and encounter id."""
    kept = encounters.filter(F.col("encounter_class").isin(*settings)).join(
        cohort.select("patient_id"), "patient_id", "left_semi"
    )
    linked = neighbours(
        kept, ["patient_id"], ["start_at", "encounter_id"], F.to_date("start_at"),
        ["encounter_id", "encounter_class", "start_at", "stop_at"], min_rows,
    )
    return linked.select(
        *kept.columns,
        F.col("_prev.encounter_id").alias("prev_encounter_id"),
        F.col("_prev.encounter_class").alias("prev_setting"),
        F.col("_prev.stop_at").alias("prev_discharge"),
        F.col("_next.encounter_id").alias("next_encounter_id"),
        F.col("_next.encounter_class").alias("next_setting"),
        F.col("_next.start_at").alias("next_admission"),
    )


def care_transitions(
    sequence: DataFrame,
    focus: str,
    readmit_settings: Sequence[str],
    window_days: int = 30,
    min_gap_days: int | None = None,
    mode: str = "next",
    ids: str = "dense",
    min_rows: int = HOT_ROWS,
    encounters: DataFrame | None = None,
) -> DataFrame:
    """One row per stay of class `focus`.

    `mode="next"` tests only the encounter that follows, and a negative gap (overlapping stays) counts unless
    `min_gap_days` is set. `mode="any_within"` tests every later encounter that starts from discharge on.
    `ids="dense"` numbers the stays by admission; `ids="hash"` needs no shuffle and does not change when late
    stays arrive. The numbers are made from `encounters` if given, which spares reading the sequence again; its
    stays of class `focus` must be those of the sequence, as they are for a cohort of all patients with one.
    """
    gap = days("next_admission", "stop_at")
    stays = sequence.filter(F.col("encounter_class") == focus)
    if mode == "next":
        hit = F.col("next_setting").isin(*readmit_settings) & (gap <= window_days)
        if min_gap_days is not None:
            hit = hit & (gap >= min_gap_days)
        stays = stays.withColumn("readmitted", F.coalesce(hit, F.lit(False)))
    elif mode == "any_within":
        first = F.to_date(F.date_add(F.to_date("stop_at"), min_gap_days or 0))
        again = sequence.filter(F.col("encounter_class").isin(*readmit_settings)).select(
            "patient_id", F.to_date("start_at").alias("_s"), F.to_date("start_at").alias("_e")
        )
        bounds = stays.select(
            "encounter_id", "patient_id", first.alias("_lo"), F.date_add(F.to_date("stop_at"), window_days).alias("_hi")
        )
        found = overlap_counts(bounds, {"_hits": again}, "patient_id", "encounter_id", "_lo", "_hi", "_s", "_e")
        stays = stays.join(found, "encounter_id", "left").withColumn(
            "readmitted", F.coalesce(F.col("_hits") > 0, F.lit(False))
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if ids == "dense" and encounters is not None:
        focused = encounters.filter((F.col("encounter_class") == focus) & F.col("patient_id").isNotNull())
        numbers = dense_ids(focused.select("encounter_id", "start_at"), "start_at", "encounter_id", "transition_id", min_rows)
        stays = stays.join(numbers.drop("start_at"), "encounter_id")
    elif ids == "dense":
        stays = dense_ids(stays, "start_at", "encounter_id", "transition_id", min_rows)
    else:
        stays = stays.withColumn("transition_id", F.xxhash64("encounter_id"))
    extra = [c for c in ("organization_id", "provider_id", "reason", "reason_detail", "payer") if c in sequence.columns]
    return stays.select(
        "transition_id", "patient_id", "encounter_id",
        F.col("encounter_class").alias("current_setting"),
        F.col("start_at").alias("admission_date"),
        F.col("stop_at").alias("discharge_date"),
        days("stop_at", "start_at").alias("length_of_stay"),
        "total_cost", *extra,
        "prev_encounter_id",
        F.col("prev_setting").alias("from_setting"),
        F.col("prev_discharge").alias("from_discharge_date"),
        days("start_at", "prev_discharge").alias("days_between_settings"),
        "next_encounter_id",
        F.col("next_setting").alias("to_setting"),
        F.col("next_admission").alias("to_admission_date"),
        gap.alias("days_to_next_encounter"),
        "readmitted",
    )


def close_open_stays(transitions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Give open stays `as_of` as their end; without it they keep a null end and match no fact."""
    if as_of is None:
        return transitions
    return transitions.withColumn("discharge_date", F.coalesce("discharge_date", as_of))


def active_facts(transitions: DataFrame, facts: DataFrame, min_rows: int = HOT_STAYS) -> DataFrame:
    """One row per (transition, fact) where the fact holds at some time of the stay."""
    stays = transitions.select("transition_id", "patient_id", "admission_date", "discharge_date")
    return interval_join(
        stays, facts, "patient_id", "admission_date", "discharge_date", "start_at", "stop_at", min_rows
    ).drop("admission_date", "discharge_date")


def active_counts(
    transitions: DataFrame, facts: dict[str, DataFrame] | tuple[DataFrame, dict[str, Column]], min_rows: int = HOT_STAYS
) -> DataFrame:
    """Transitions with one count column per sort of fact (as in `overlap_counts`): facts held during the stay, 0 if none."""
    counts = overlap_counts(
        transitions, facts, "patient_id", "transition_id", "admission_date", "discharge_date", "start_at", "stop_at",
        min_rows,
    )
    names = facts if isinstance(facts, dict) else facts[1]
    return transitions.join(counts, "transition_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in names}
    )


class Clinical(NamedTuple):
    """Conditions, medications and allergies as rows of one table, with what makes a row one of each; a row may be several.

    The table has the columns of all three but those that `details` gives by the column `detail`; a row counts as
    often as it has details, and not without any.
    """

    table: DataFrame
    details: DataFrame
    conditions: Column
    medications: Column
    allergies: Column

    @property
    def sorts(self) -> tuple[Column, ...]:
        return self.conditions, self.medications, self.allergies

    def whole(self) -> DataFrame:
        return self.table.join(self.details, "detail")


def profile_counts(
    transitions: DataFrame, conditions: DataFrame, medications: DataFrame, allergies: DataFrame,
    min_rows: int = HOT_STAYS, together: Clinical | None = None,
) -> DataFrame:
    """Transitions with the number of active conditions, medications and allergies, in one pass.

    `together`, if given, stands for the three tables and spares making each of them from a table they share.
    """
    names = ("n_conditions", "n_medications", "n_allergies")
    if together is not None:
        return active_counts(transitions, (together.whole(), dict(zip(names, together.sorts, strict=True))), min_rows)
    return active_counts(transitions, dict(zip(names, (conditions, medications, allergies), strict=True)), min_rows)


CONDITION_FIELDS = {"description": "condition", "code": "code"}
MEDICATION_FIELDS = {"description": "medication", "code": "code", "reason": "reason"}
ALLERGY_FIELDS = {"description": "allergy", "code": "code", "category": "category", "severity": "severity"}


def transition_profiles(
    transitions: DataFrame, conditions: DataFrame, medications: DataFrame, allergies: DataFrame,
    part_size: int = 5_000, limit: int | None = None, min_rows: int = HOT_STAYS, together: Clinical | None = None,
) -> DataFrame:
    """Clinical state per transition as arrays of structs; arrays are empty, never null.

    A transition has one row (part 0) unless it holds more than `part_size` facts of one sort: then its facts
    are dealt over several parts by their hash, so no row grows without bound and none is left out. Equal facts
    are merged with their number in `copies`. The counts are those of the whole transition on every part.
    `limit` keeps the first transitions by id, for trial runs. `together` is that of `profile_counts`.
    """
    if limit is not None:
        transitions = transitions.orderBy("transition_id").limit(limit)
    largest = F.greatest("n_conditions", "n_medications", "n_allergies")
    kinds = {
        "active_conditions": (conditions, CONDITION_FIELDS),
        "active_medications": (medications, MEDICATION_FIELDS),
        "allergies": (allergies, ALLERGY_FIELDS),
    }
    fields = list(dict.fromkeys(c for _, names in kinds.values() for c in names))
    keys = ["patient_id", "start_at", "stop_at", "_kind", *fields]
    parts = F.greatest(F.ceil(largest / F.lit(part_size)), F.lit(1)).cast("int")
    if together is None:
        counted = profile_counts(transitions, conditions, medications, allergies, min_rows)
        # read for the join with facts and again for the result
        stays = stage(counted.withColumn("_parts", parts), "counted")
        facts = None
        for kind, (table, names) in kinds.items():
            one = table.select(
                "patient_id", "start_at", "stop_at", F.lit(kind).alias("_kind"),
                *[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in fields],
            )
            facts = one if facts is None else facts.unionByName(one)
        held = interval_join(
            stays.select("transition_id", "patient_id", "admission_date", "discharge_date", "_parts"),
            facts.groupBy(*keys).agg(n_rows().alias("copies")),
            "patient_id", "admission_date", "discharge_date", "start_at", "stop_at", min_rows,
        )
        whole = stays.filter("_parts > 1").isEmpty()
    else:
        numbered = stage(transitions.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = _found_facts(numbered, together, kinds, fields, min_rows)
        names = dict(zip(kinds, ("n_conditions", "n_medications", "n_allergies"), strict=True))
        counts = found.groupBy("transition_id").agg(*[F.count_if(F.col("_kind") == k).alias(n) for k, n in names.items()])
        stays = stage(
            numbered.drop("_row").join(counts, "transition_id", "left")
            .withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in names.values()}).withColumn("_parts", parts),
            "counted",
        )
        large = stays.filter("_parts > 1").select("transition_id", "_parts").distinct()
        whole = large.isEmpty()
        if whole:
            # few facts for each transition: dealt by it once, they are merged and gathered where they are
            found = found.repartition("transition_id").withColumn("_parts", F.lit(1))
        else:
            found = found.join(large, "transition_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        held = found.groupBy("transition_id", "_row", "_parts", *keys).agg(n_rows().alias("copies"))
    started = F.date_format("start_at", "yyyy-MM-dd").alias("started")
    arrays = {}
    for kind, (_, names) in kinds.items():
        item = F.struct(*[F.col(c).alias(alias) for c, alias in names.items()], started, "copies")
        arrays[kind] = F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, item)))
    # with one part each, rows stay dealt by transition for those who put the parts together again
    page = ["transition_id"] if whole else ["transition_id", "part"]
    pages = (
        held.withColumn("part", F.pmod(F.xxhash64(*keys[1:]), F.col("_parts")).cast("int"))
        .groupBy(*page)
        .agg(*[a.alias(kind) for kind, a in arrays.items()])
    )
    part = F.lit(0) if whole else F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        stays.withColumn("part", part).drop("_parts")
        .join(pages, page, "left")
        .select("transition_id", "part", *[c for c in stays.columns if c not in ("transition_id", "_parts")],
                *[F.coalesce(k, F.array().cast(pages.schema[k].dataType)).alias(k) for k in kinds])
    )


def _found_facts(numbered: DataFrame, together: Clinical, kinds: dict, fields: list[str], min_rows: int) -> DataFrame:
    """A written row for each fact that a stay meets and each sort of it. Details are joined to what was met only."""
    met = interval_join(
        numbered.select("_row", "transition_id", "patient_id", "admission_date", "discharge_date"), together.table,
        "patient_id", "admission_date", "discharge_date", "start_at", "stop_at", min_rows,
    )
    tags = [F.when(one, F.lit(kind)) for kind, one in zip(kinds, together.sorts, strict=True)]
    marked = met.join(together.details, "detail").select(
        "_row", "transition_id", "patient_id", "start_at", "stop_at", *fields,
        F.explode(F.array_compact(F.array(*tags))).alias("_kind"),
    )
    return stage(marked.withColumns({
        c: F.when(F.col("_kind").isin(*[kind for kind, (_, names) in kinds.items() if c in names]), F.col(c)) for c in fields
    }), "found")


def recent_observations(transitions: DataFrame, observations: DataFrame) -> DataFrame:
    """Last value of each vital up to discharge, per transition, and how many readings there were by then.

    Readings and discharges lie on one line per patient and vital, cut into months; each discharge takes the last
    reading before it, from its own month or carried over from an earlier one. No (stay, reading) pairs are formed.
    """
    keys = ["patient_id", "vital"]
    # read for the line, its months and the vitals of a patient
    observations = stage(observations.select(*keys, "observed_at", "observation_id", "value"), "observations")
    reading = F.struct("observed_at", "observation_id", F.col("value").cast("bigint").alias("value"))
    readings = observations.filter(F.col("observed_at").isNotNull()).select(
        *keys, F.col("observed_at").alias("_at"), F.lit(None).cast("string").alias("transition_id"), reading.alias("_reading")
    )
    stays = transitions.filter(F.col("discharge_date").isNotNull())
    ids = dict(stays.dtypes)["transition_id"]
    marks = (
        stays.select("transition_id", "patient_id", F.col("discharge_date").alias("_at"))
        .join(observations.select(*keys).distinct(), "patient_id")
        .select(*keys, "_at", F.col("transition_id").cast("string").alias("transition_id"),
                F.lit(None).cast(readings.schema["_reading"].dataType).alias("_reading"))
    )
    line = readings.unionByName(marks).withColumn("_month", F.trunc("_at", "month"))
    inner = (
        Window.partitionBy(*keys, "_month").orderBy("_at", F.col("transition_id").isNotNull(), "_reading")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = (
        readings.withColumn("_month", F.trunc("_at", "month")).groupBy(*keys, "_month")
        .agg(F.max("_reading").alias("_last"), n_rows().alias("_n"))
    )
    # months that hold only discharges carry over too
    carried = (
        line.select(*keys, "_month").distinct().join(months, [*keys, "_month"], "left")
        .select(*keys, "_month", F.last("_last", True).over(before).alias("_earlier"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sofar"))
    )
    met = (
        line.withColumn("_own", F.last("_reading", True).over(inner)).withColumn("_count", F.count("_reading").over(inner))
        .filter(F.col("transition_id").isNotNull()).join(carried, [*keys, "_month"])
        .withColumn("_found", F.coalesce("_own", "_earlier")).filter(F.col("_found").isNotNull())
    )
    return met.select(
        F.col("transition_id").cast(ids).alias("transition_id"), "vital", F.col("_found.value").alias("last_value"),
        F.col("_found.observed_at").alias("observed_at"), (F.col("_count") + F.col("_sofar")).cast("bigint").alias("n_readings"),
    )


def encounter_timeline(encounters: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Encounters with their place (1, 2, …) in the patient's history."""
    placed = running_sums(
        encounters, ["patient_id"], ["start_at", "encounter_id"], F.to_date("start_at"), {"_n": F.lit(1)}, min_rows
    )
    return placed.withColumn("position", (F.col("_n") + 1).cast("bigint")).drop("_n")


def timeline_pages(encounters: DataFrame, page_size: int = 1_000, min_rows: int = HOT_ROWS) -> DataFrame:
    """Timeline arrays per patient, at most `page_size` encounters in each row."""
    item = F.struct("position", "encounter_id", "encounter_class", "start_at", "stop_at")
    return (
        encounter_timeline(encounters, min_rows)
        .withColumn("page", F.floor((F.col("position") - 1) / page_size).cast("int"))
        .groupBy("patient_id", "page")
        .agg(F.array_sort(F.collect_list(item)).alias("timeline"))
    )


def prior_readmissions(transitions: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Number of earlier stays and of earlier readmissions of the same patient at each transition."""
    return running_sums(
        transitions, ["patient_id"], ["admission_date", "encounter_id"], F.to_date("admission_date"),
        {"prior_stays": F.lit(1), "prior_readmissions": F.col("readmitted").cast("int")}, min_rows,
    ).withColumns({c: F.col(c).cast("bigint") for c in ("prior_stays", "prior_readmissions")})
