import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from transitus.operators import approval, guardrails, metrics

T0 = datetime(2024, 1, 1)
EVENTS = "log_id int, transition_id int, action string, actor string, actor_role string, section string, action_at timestamp"


def log(spark, rows):
    return spark.createDataFrame(
        [(i, t, a, f"{r}-1", r, "clinical_handoff", T0 + timedelta(hours=h)) for i, (t, a, r, h) in enumerate(rows)], EVENTS
    )


def test_state(spark):
    events = log(spark, [
        (1, "GENERATED", "SYSTEM", 0), (1, "ASSIGNED", "MD", 1), (1, "VIEWED", "MD", 2), (1, "APPROVED", "MD", 3), (1, "EDITED", "MD", 4),
        (1, "SENT", "MD", 5),
        (2, "APPROVED", "MD", 1),
        (3, "ASSIGNED", "NP", 1), (3, "REJECTED", "NP", 2), (3, "APPROVED", "MD", 3), (3, "APPROVED", "MEDICAL_DIRECTOR", 4),
        (4, "ASSIGNED", "NP", 1), (4, "REJECTED", "NP", 2), (4, "GENERATED", "SYSTEM", 3),
    ])
    got = {r.transition_id: r for r in approval.approval_state(events).collect()}
    assert (got[1].status, got[1].n_illegal, got[1].approved_at) == ("SENT", 1, T0 + timedelta(hours=3))
    assert (got[2].status, got[2].n_illegal, got[2].approved_at) == ("DRAFT", 1, None)
    assert (got[3].status, got[3].n_illegal, got[3].reviewer_name) == ("APPROVED", 1, "MEDICAL_DIRECTOR-1")
    assert (got[4].status, got[4].n_illegal) == ("DRAFT", 0)
    state = approval.approval_state(events)
    assert [r.transition_id for r in approval.expired_approvals(state, T0 + timedelta(hours=77)).collect()] == [3]
    assert approval.expired_approvals(state, T0 + timedelta(hours=76)).count() == 0
    assert approval.canonical_status(F.lit("REVIEWED")) is not None


def test_fold_in_pieces(spark):
    """Cutting a long log into days changes nothing, nor does the order of the rows."""
    rng = random.Random(11)
    actions = ["GENERATED", "ASSIGNED", "VIEWED", "EDITED", "APPROVED", "REJECTED", "SENT"]
    rows = [(rng.choice([1, 1, 2, 3]), rng.choice(actions), rng.choice(["MD", "NP", "MEDICAL_DIRECTOR"]), rng.randint(0, 400)) for _ in range(300)]
    events = log(spark, rows)
    plain = sorted(map(tuple, approval.approval_state(events).collect()))
    assert sorted(map(tuple, approval.approval_state(events.orderBy(F.rand(1)), min_rows=1).collect())) == plain
    assert sorted(map(tuple, approval.approval_state(events, min_rows=100).collect())) == plain


def test_roles(spark):
    events = log(spark, [(1, "APPROVED", "NP", 0), (1, "APPROVED", "RN", 0), (1, "VIEWED", "COORDINATOR", 0), (1, "VIEWED", "RN", 0)])
    assert [r.authorized for r in approval.authorize(events).orderBy("log_id").collect()] == [True, False, False, True]


def test_signature_breaks_on_change(spark):
    events = log(spark, [(1, "ASSIGNED", "MD", 1), (1, "APPROVED", "MD", 3), (2, "ASSIGNED", "MD", 1), (2, "APPROVED", "MD", 2)])
    docs = spark.createDataFrame([(1, "text"), (2, "other")], "transition_id int, clinical_handoff string")
    signed = approval.sign(approval.approval_state(events), docs)
    changed = docs.withColumn("clinical_handoff", F.when(F.col("transition_id") == 2, "edited").otherwise(F.col("clinical_handoff")))
    assert {r.transition_id: r.verified for r in approval.verify_signature(signed, changed).collect()} == {1: True, 2: False}


def test_no_approved_documents(spark):
    state = approval.approval_state(log(spark, [(1, "VIEWED", "MD", 1)]))
    edits = spark.createDataFrame([(1, 1, "a", "b", "c")], "transition_id int, edit_id int, section string, original_text string, edited_text string")
    assert approval.edit_rate(edits, state).first().edit_rate_pct is None
    assert approval.approval_latency(state).first().avg_hours is None


def test_queue_order(spark):
    state = approval.approval_state(log(spark, [(i, "ASSIGNED", "MD", i) for i in (1, 2, 3)]))
    docs = spark.createDataFrame([(1, "LOW"), (2, "HIGH"), (3, "MEDIUM")], "transition_id int, risk_tier string")
    cohort = spark.createDataFrame([(7, "p", 80, "F")], "patient_id int, patient_name string, age int, gender string")
    stays = spark.createDataFrame([(i, 7, "home", 3) for i in (1, 2, 3)], "transition_id int, patient_id int, from_setting string, length_of_stay int")
    assert [r.risk_tier for r in metrics.review_queue(state, docs, cohort, stays).collect()] == ["HIGH", "MEDIUM", "LOW"]
    assert metrics.review_queue(state, docs, cohort, stays, status="APPROVED").count() == 0


def test_document_checks(spark):
    x = F.col("clinical_handoff")
    docs = spark.createDataFrame([
        (1, "Diagnosis: CKD. Medication: stop taking the pill"), (2, "Diagnoses. Medications. Aspirin daily, it might help."),
        (3, None), (4, "Diagnosis and medication list, discontinue warfarin immediately; aspirin listed."), (5, "Increase the dose"),
    ], "transition_id int, clinical_handoff string")
    listed = spark.createDataFrame([(4, "Aspirin"), (4, "Warfarin")], "transition_id int, term string")
    out = {r.transition_id: r for r in guardrails.quality_checks(docs, listed, ["aspirin", "Warfarin"]).collect()}
    assert out[1].action == "BLOCK_PHARMACIST_REVIEW" and out[2].action == "INVALID_HUMAN_REVIEW"
    assert out[3].action == "MARK_INCOMPLETE" and out[3].completeness_check == "INCOMPLETE"
    assert out[4].n_unlisted == 0 and out[4].safety_language_check == "DANGEROUS_LANGUAGE"
    assert out[5].safety_language_check == "DANGEROUS_LANGUAGE"
    assert out[2].uncertainty_check == "UNCERTAIN"
    assert docs.select(guardrails.longest_sentence(x).alias("n")).collect()[1].n == 5


def test_thresholds(spark):
    rows = spark.createDataFrame([("edit_rate_pct", 60.0), ("approval_hours", 1.0), ("hallucination_rate_pct", None)], "metric string, value double")
    got = {r.metric: (r.status, r.action) for r in guardrails.monitor_thresholds(rows).collect()}
    assert got == {"edit_rate_pct": ("ALERT", "retune prompts"), "approval_hours": ("OK", None), "hallucination_rate_pct": (None, None)}


@pytest.mark.parametrize("waited,unpaid,status", [(61, 1.0, "LIKELY_DENIED"), (60, 1.0, "PENDING"), (99, 0.0, "PAID"), (99, None, "PAID")])
def test_payment_status(spark, waited, unpaid, status):
    from transitus.operators.denial import payment_status

    row = spark.range(1).select(payment_status(F.lit(unpaid).cast("double"), F.lit(waited)).alias("s"))
    assert row.first().s == status


def test_fold_of_one_long_day(spark):
    """One document with very many events in one day: pieces are bounded, and the end is that of a plain loop."""
    n, actions = 200_000, ["GENERATED", "ASSIGNED", "VIEWED", "EDITED", "REJECTED", "APPROVED", "VIEWED"]
    pick = F.pmod(F.xxhash64("id"), F.lit(len(actions)))
    events = spark.range(n).select(
        F.col("id").alias("log_id"), F.lit(1).alias("transition_id"),
        F.element_at(F.array(*[F.lit(a) for a in actions]), (pick + 1).cast("int")).alias("action"),
        F.lit("x").alias("actor"), F.lit("MD").alias("actor_role"), F.lit("key_risks").alias("section"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") / 10)).alias("action_at"),
    )
    got = approval.approval_state(events, min_rows=5_000).first()
    state, bad = approval.REVIEW.initial, 0
    legal = {*approval.REVIEW.moves, *approval.REVIEW.stays}
    for row in events.select("action").orderBy("log_id").collect():
        bad += (state, row.action) not in legal
        state = approval.REVIEW.moves.get((state, row.action), state)
    assert (got.status, got.n_events, got.n_illegal) == (state, n, bad)


def costs(old, new):
    """(edits, replacements) of the best alignment from the full table of costs."""
    row = [(j, 0) for j in range(len(new) + 1)]
    for i, a in enumerate(old, 1):
        above, row = row, [(i, 0)]
        for j, b in enumerate(new, 1):
            same = a == b
            row.append(min(
                (above[j - 1][0] + (not same), above[j - 1][1] + (not same)), (above[j][0] + 1, above[j][1]), (row[-1][0] + 1, row[-1][1])
            ))
    return row[-1]


@pytest.mark.parametrize("band", [1, 2, 64])
def test_alignment_equals_brute_force(band):
    rng = random.Random(band)
    for _ in range(400):
        old = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        new = [rng.choice("abcd") for _ in range(rng.randint(0, 14))] if rng.random() < 0.5 else [w for w in old if rng.random() < 0.8]
        inserted, deleted, replaced, kept = approval.align_words(old, new, band)
        assert (inserted + deleted + replaced, replaced) == costs(old, new), (old, new)
        assert deleted + replaced + kept == len(old) and inserted + replaced + kept == len(new)


def test_alignment_of_long_texts():
    """Two texts of 200,000 words with a few edits at both ends: one band of diagonals, not a table."""
    old = [str(i) for i in range(200_000)]
    new = ["x", *old[:100], *old[101:199_990], "y", *old[199_991:]]
    assert approval.align_words(old, new) == (1, 1, 1, 199_998)


def test_edit_alignment(spark):
    rows = [(1, 1, "a", "one two three", "one three two"), (1, 2, "a", None, "new words"), (1, 3, "a", "gone", ""), (1, 4, "a", None, None),
            (1, 5, "a", "The cat sat", "the dog sat down"), (1, 5, "a", "The cat sat", "the dog sat down")]
    edits = spark.createDataFrame(rows, "transition_id int, edit_id int, section string, original_text string, edited_text string")
    got = sorted((r.edit_id, r.inserted, r.deleted, r.replaced, r.kept, r.changed_pct) for r in approval.edit_alignment(edits).collect())
    assert got == [(1, 1, 1, 0, 2, 100.0 * 2 / 3), (2, 2, 0, 0, 0, 100.0), (3, 0, 1, 0, 0, 100.0), (4, 0, 0, 0, 0, None),
                   (5, 1, 0, 1, 2, 50.0), (5, 1, 0, 1, 2, 50.0)]
    assert approval.edit_alignment(edits.limit(0)).count() == 0
