"""Declared tables: columns, types, defaults and text lengths. Nothing is inferred on read."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOW = object()


@dataclass(frozen=True)
class Table:
    ddl: str
    defaults: dict[str, object] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    def rows(self, df: DataFrame, as_of: datetime) -> DataFrame:
        """`df` with all declared columns in order: missing ones get their default, `NOW` being `as_of`."""
        out = []
        for f in self.schema:
            default = self.defaults.get(f.name)
            value = F.lit(as_of if default is NOW else default)
            if f.name in df.columns:
                value = F.col(f.name) if default is None else F.coalesce(F.col(f.name), value)
            out.append(value.cast(f.dataType).alias(f.name))
        return df.select(*out)

    def too_long(self, df: DataFrame) -> DataFrame:
        """Rows with a text longer than declared; file formats do not enforce lengths."""
        bad = F.lit(False)
        for name, n in self.lengths.items():
            bad = bad | F.coalesce(F.length(name) > n, F.lit(False))
        return df.filter(bad)


# Columns, defaults and lengths of the stored tables.
NARRATIVES = Table(
    "transition_id BIGINT, patient_id BIGINT, generated_at TIMESTAMP, risk_tier STRING, clinical_handoff STRING, "
    "family_summary STRING, medication_reconciliation STRING, key_risks STRING, follow_up_actions STRING",
    {"generated_at": NOW}, {"risk_tier": 10},
)
APPROVALS = Table(
    "approval_id BIGINT, transition_id BIGINT, status STRING, assigned_to STRING, assigned_role STRING, "
    "assigned_at TIMESTAMP, reviewed_at TIMESTAMP, reviewer_name STRING, reviewer_credentials STRING, "
    "review_notes STRING, sections_edited ARRAY<STRING>, edit_reason STRING, approved_at TIMESTAMP, "
    "digital_signature STRING, approval_expiry TIMESTAMP, rejected_at TIMESTAMP, rejection_reason STRING, "
    "regeneration_requested BOOLEAN, sent_at TIMESTAMP, sent_to STRING, send_method STRING, created_at TIMESTAMP, "
    "last_modified TIMESTAMP",
    {"status": "DRAFT", "regeneration_requested": False, "created_at": NOW, "last_modified": NOW},
    {"status": 20, "assigned_to": 200, "assigned_role": 50, "reviewer_name": 200, "reviewer_credentials": 50,
     "digital_signature": 500, "sent_to": 500, "send_method": 50},
)
EDITS = Table(
    "edit_id BIGINT, transition_id BIGINT, section_name STRING, original_text STRING, edited_text STRING, "
    "edited_by STRING, edited_at TIMESTAMP, edit_type STRING",
    {"edited_at": NOW}, {"section_name": 50, "edited_by": 200, "edit_type": 20},
)
AUDIT_LOG = Table(
    "log_id BIGINT, transition_id BIGINT, action STRING, actor STRING, actor_role STRING, action_timestamp TIMESTAMP, details STRING",
    {"action_timestamp": NOW}, {"action": 50, "actor": 200, "actor_role": 50},
)
RECOMMENDATIONS = Table(
    "recommendation_id BIGINT, patient_id BIGINT, encounter_id BIGINT, analysis_type STRING, source_document STRING, "
    "missed_conditions ARRAY<STRING>, current_codes ARRAY<STRING>, recommended_additions ARRAY<STRING>, "
    "daily_revenue_gap DOUBLE, total_revenue_opportunity DOUBLE, justification STRING, status STRING, "
    "reviewed_by STRING, reviewed_at TIMESTAMP, created_at TIMESTAMP",
    {"status": "PENDING", "created_at": NOW}, {"analysis_type": 10, "status": 20, "reviewed_by": 200},
)

# Public files, read with a schema.
STAR_RATINGS = (
    "facility_id STRING, facility STRING, state STRING, ownership STRING, certified_beds INT, daily_census DOUBLE, "
    "overall_rating INT, inspection_rating INT, staffing_rating INT, quality_rating INT, payment_denials INT"
)
DEFICIENCIES = "facility_id STRING, f_tag STRING, severity STRING, survey_date DATE, scope_severity STRING, corrected_at DATE"
QUALITY_MEASURES = "facility_id STRING, measure STRING, score DOUBLE"
UTILISATION = "facility_id STRING, stays BIGINT, total_days BIGINT, payments DOUBLE, charges DOUBLE"
CODE_MAP = "code STRING, description STRING, category STRING"
RATE_TABLE = "component STRING, class STRING, rate DOUBLE, urban BOOLEAN"
