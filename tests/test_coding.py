"""Worked examples: a discharge summary with codes and a progress note without any. Texts are our own."""

import pytest
from pyspark.sql import functions as F

from transitus.operators import reimbursement as rb

SUMMARY = """PRINCIPAL: hip fracture after repair (S72.141A)
SECONDARY: diabetes with kidney disease (E11.22); kidney disease stage 3b (N18.32); osteoporosis with fracture (M80.08XA);
depression (F33.1); severe obesity, BMI 38.2 (E66.01); chronic pain (G89.29); sleep apnea (G47.33); anemia (D50.9).
GIVEN: 2u blood, cefazolin for 48hrs; room B12, ward Z9"""
CODES = ["D50.9", "E11.22", "E66.01", "F33.1", "G47.33", "G89.29", "M80.08XA", "N18.32", "S72.141A"]

NOTE = """Walks with help. BMI 32.4 today. Known Stage 3 CKD. Scan confirms osteoporosis, T-score -3.2.
Feels down, PHQ-9 score 12. Chronic low back pain continues. Denies chest pain. No asthma. Family history of stroke.
Likely obesity hypoventilation."""


def test_discharge_summary(spark):
    docs = spark.createDataFrame([(1, SUMMARY)], "patient_id int, text string")
    known = spark.createDataFrame([(c,) for c in CODES], "code string")
    found = rb.extract_codes(docs, known, ["patient_id"])
    assert sorted(r.code for r in found.collect()) == CODES
    assessed = spark.createDataFrame([(1, "s72141a"), (1, "I10"), (1, "E11.9")], "patient_id int, code string")
    missed = {r.code: r.refines for r in rb.missed_codes(found, assessed).collect()}
    assert "S72.141A" not in missed and len(missed) == 8
    assert missed["E11.22"] and not missed["D50.9"]
    impact = known.select("code", F.lit("NURSING").alias("component"), F.lit(10).cast("decimal(18,2)").alias("daily_value"))
    gap = rb.discharge_gap(found, assessed, impact).first()
    assert (gap.missed, gap.daily_gap, gap.projected_recovery) == (8, 10.0, 210.0)


def test_progress_note(spark):
    notes = spark.createDataFrame([(1, NOTE)], "patient_id int, text string")
    synonyms = spark.createDataFrame(
        [("stage 3 ckd", "N18.30"), ("osteoporosis", "M81.0"), ("chronic low back pain", "M54.5"), ("asthma", "J45.9"),
         ("stroke", "Z82.3"), ("chest pain", "R07.9"), ("obesity hypoventilation", "E66.2")],
        "phrase string, code string",
    )
    terms = rb.extract_terms(notes, synonyms, 4, ["patient_id"])
    assert sorted(r.code for r in terms.collect()) == ["E66.2", "M54.5", "M81.0", "N18.30"]
    measured = rb.measured_terms(notes, ["patient_id"])
    assert {r.phrase: r.sentence for r in measured.collect()} == {
        "obesity": "BMI 32.4 today", "osteoporosis": "Scan confirms osteoporosis, T-score -3.2",
        "moderate depression": "Feels down, PHQ-9 score 12",
    }


MIXED = """No fever today but CKD stage 3 is worse. Known asthma, denies stroke, gout. No BMI 40 except PHQ-9 score 14.
Without chest pain, gout; BMI 33.1 today. Denies stroke, reports back pain. Chronic; no change; back pain. Family history: gout."""


def test_negation_ends_with_its_clause(spark):
    notes = spark.createDataFrame([(1, MIXED)], "patient_id int, text string")
    synonyms = spark.createDataFrame(
        [(p, p) for p in ("ckd stage 3", "fever", "asthma", "stroke", "gout", "chest pain", "back pain", "chronic back pain")], "phrase string, code string"
    )
    terms = {(r.phrase, r.sentence) for r in rb.extract_terms(notes, synonyms, 3, ["patient_id"]).collect()}
    assert terms == {
        ("ckd stage 3", "No fever today but CKD stage 3 is worse"), ("asthma", "Known asthma, denies stroke, gout"),
        ("back pain", "Denies stroke, reports back pain"), ("back pain", "Chronic; no change; back pain"),
    }
    measured = {r.phrase: r.sentence for r in rb.measured_terms(notes, ["patient_id"]).collect()}
    assert measured == {
        "moderate depression": "No BMI 40 except PHQ-9 score 14", "obesity": "Without chest pain, gout; BMI 33.1 today",
    }


def test_notes_are_read_once_for_phrases_and_measures(spark):
    """One pass gives the terms of both, each once, and a phrase that looks like a measure's mark finds nothing."""
    notes = spark.createDataFrame([(1, MIXED), (1, NOTE), (1, NOTE), (None, NOTE), (2, None), (3, " . =0 = 0 .")], "patient_id int, text string")
    synonyms = spark.createDataFrame([(p, p) for p in ("ckd stage 3", "gout", "asthma", "=0", "back pain")] + [(None, "x")], "phrase string, code string")
    apart = rb.extract_terms(notes, synonyms, 3, ["patient_id"]).unionByName(rb.measured_terms(notes, ["patient_id"])).distinct()
    both = rb.note_terms(notes, synonyms, 3, ["patient_id"])
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(key, both.collect())) == sorted(map(key, apart.collect()))
    assert both.filter("phrase = 'obesity'").count() == 3
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace") == 1 and plan.count("regexp_replace(sentence") == 1


def test_rates(spark):
    classes = spark.createDataFrame([(1, "B", "C", "A"), (2, "A", "A", "D")], "patient_id int, nursing_class string, nta_class string, therapy_class string")
    rates = [("NURSING", "A", 100.0), ("NURSING", "B", 150.0), ("NTA", "A", 10.0), ("NTA", "C", 60.25)]
    rates += [(c, k, v) for c in rb.THERAPIES for k, v in (("A", 20.0), ("D", 80.1))]
    optimal = rb.optimal_daily_rate(classes, rates, 90.0)
    assert {r.patient_id: r.optimal_rate for r in optimal.collect()} == {1: 360.25, 2: 440.3}
    actual = spark.createDataFrame([(1, 260.25), (2, None)], "patient_id int, actual_rate double")
    assert {r.patient_id: r.undercoded for r in rb.undercoded(optimal, actual).collect()} == {1: False, 2: False}
    assert rb.undercoded(optimal, actual, above=99.0).filter("undercoded").count() == 1


def test_zero_day_stay_has_no_rate(spark):
    stays = spark.sql("SELECT 1 AS patient_id, timestamp'2024-01-01' AS start_at, timestamp'2024-01-01' AS stop_at, cast(5 AS decimal(18,2)) AS total_cost")
    assert rb.actual_daily_rate(stays).first().actual_rate is None


def test_recommendations(spark):
    rows = [(1, 1, "ACCEPTED"), (1, 2, "DISMISSED"), (2, 1, "DISMISSED"), (2, 2, "REOPENED"), (3, 1, "VIEWED")]
    events = spark.createDataFrame([(k, i, a) for k, i, a in rows], "recommendation_id int, id int, action string").select(
        "*", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id"))).alias("at"), F.lit("x").alias("actor"), F.lit("MD").alias("role")
    )
    got = {r.recommendation_id: (r.status, r.n_illegal) for r in rb.recommendation_state(events).collect()}
    assert got == {1: ("ACCEPTED", 1), 2: ("PENDING", 0), 3: ("PENDING", 0)}


@pytest.mark.parametrize("level,patients,gap", [(0, 1, 5.0), (1, 2, 12.0), (3, 3, 13.0)])
def test_rollup(spark, level, patients, gap):
    gaps = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 1.0)], "organization_id int, daily_gap double")
    facilities = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "organization_id int, chain string")
    rows = rb.revenue_impact(gaps, facilities).filter(F.col("level") == level).orderBy("chain", "organization_id").collect()
    assert (rows[0].patients, rows[0].daily_gap) == (patients, gap)


def test_rate_spread(spark):
    """A group of one, ties, null rates and a null group."""
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", 7.0)] + [("c", 2.0)] * 5 + [("c", None), (None, 3.0), ("d", None)]
    out = rb.rate_spread(spark.createDataFrame(rows, "payer string, actual_rate double"), ["payer"], width=3.0)
    got = {r.payer: (r.rates, r.lowest, r.p10, r.p25, r.p50, r.p75, r.p90, r.highest) for r in out.collect()}
    assert got == {"a": (10, 1.0, 1.0, 3.0, 5.0, 8.0, 9.0, 10.0), "b": (1, *[7.0] * 7), "c": (5, *[2.0] * 7)}
