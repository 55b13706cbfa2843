"""Bound tables plus the derived tables that several queries share."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitus.functions.columns import lookup
from transitus.operators import approval, cohort, guardrails, narrative
from transitus.session import stage
from transitus.sources.binding import FOCUS, READMIT, SETTINGS, Binding

AS_OF = date(2024, 6, 30)

# Words of the invented languages, so that the text checks meet both outcomes on the driver texts.
TERMS = ["the", "der", "les", "los", "of the", "the of and"]
LISTED = {"en": "the", "de": "der", "fr": "les", "es": "los"}
RISKY = [*guardrails.DANGEROUS, "%from%of the%"]
NEEDED = ["%the%", "%and%"]
DOUBT = [*guardrails.UNCERTAIN, "that it", "que la"]


class Tables(Binding):
    @cached_property
    def cohort(self) -> DataFrame:
        return cohort.patient_cohort(self.patients, self.encounters, FOCUS, AS_OF)

    @cached_property
    def sequence(self) -> DataFrame:
        return cohort.encounter_sequence(self.encounters, cohort.cohort_ids(self.encounters, FOCUS), SETTINGS)

    @cached_property
    def transitions(self) -> DataFrame:
        # read by several branches of most queries
        return stage(
            cohort.care_transitions(self.sequence, FOCUS, READMIT, encounters=self.encounters), "transitions"
        )

    @cached_property
    def profile_counts(self) -> DataFrame:
        return cohort.profile_counts(
            self.transitions, self.conditions, self.medications, self.allergies, together=self.clinical
        )

    @cached_property
    def held_medications(self) -> DataFrame:
        return cohort.active_facts(self.transitions, self.medications)

    @cached_property
    def held_conditions(self) -> DataFrame:
        return cohort.active_facts(self.transitions, self.conditions)

    @cached_property
    def prompt_variables(self) -> DataFrame:
        profiles = cohort.transition_profiles(
            self.transitions, self.conditions, self.medications, self.allergies, together=self.clinical
        )
        return narrative.prompt_variables(narrative.risk_tier(profiles), self.cohort)

    @cached_property
    def tiers(self) -> DataFrame:
        return narrative.risk_tier(self.profile_counts)

    @cached_property
    def review_state(self) -> DataFrame:
        return approval.approval_state(self.review_events)

    @cached_property
    def listed_terms(self) -> DataFrame:
        """The term each document's language "lists"."""
        return self.documents.select(F.col("doc_id").alias("transition_id"), lookup(F.col("lang"), LISTED).alias("term"))

    @cached_property
    def checks(self) -> DataFrame:
        return guardrails.quality_checks(
            self.narratives, self.listed_terms, TERMS, dangerous=RISKY, required=NEEDED, uncertain=DOUBT
        )
