"""Registered queries against DuckDB on the smallest tables; all of them with ORACLE_ALL=1."""

import os

import pytest

import oracle
from transitus.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SOME = ["patient_cohort", "care_transitions", "transition_profiles", "risk_tier", "drug_interactions", "term_hallucination",
        "approval_state", "transition_volume", "denial_risk", "optimal_daily_rate", "note_gaps", "claim_anomalies", "search_docs"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ORACLE_ALL") else SOME)
def test_same_rows(spark, con, name):
    assert oracle.compare(name, QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
