from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from transitus.functions.columns import age_years, days
from transitus.operators import cohort, narrative

READMIT = ["inpatient", "emergency"]
SETTINGS = ["inpatient", "snf", "emergency", "home", "hospice"]
D = datetime(2024, 1, 1)


def at(n):
    return D + timedelta(days=n)


@pytest.fixture(scope="module")
def encounters(spark):
    rows = [
        # patient 1: gap of exactly 30 days, then of 31
        (1, 10, "inpatient", at(0), at(5)), (1, 11, "snf", at(6), at(20)), (1, 12, "inpatient", at(50), at(52)),
        (1, 13, "snf", at(60), at(70)), (1, 14, "emergency", at(101), at(102)),
        # patient 2: equal starts, open stay, a class that does not count
        (2, 21, "snf", at(3), at(4)), (2, 20, "emergency", at(3), at(3)), (2, 22, "ambulatory", at(10), at(10)),
        (2, 23, "snf", at(30), None), (2, 24, "inpatient", at(40), at(41)),
        # patient 3: overlapping next encounter; patient 4: no focus stay; patient 5: home in between
        (3, 30, "snf", at(0), at(20)), (3, 31, "emergency", at(15), at(16)),
        (4, 40, "inpatient", at(0), at(1)),
        (5, 50, "snf", at(0), at(2)), (5, 51, "home", at(3), at(4)), (5, 52, "inpatient", at(9), at(12)),
    ]
    return spark.createDataFrame(
        [(p, e, c, a, b, 100.0, p % 2) for p, e, c, a, b in rows],
        "patient_id int, encounter_id int, encounter_class string, start_at timestamp, stop_at timestamp, total_cost double, organization_id int",
    ).withColumn("total_cost", F.col("total_cost").cast("decimal(18,2)"))


def transitions(encounters, **options):
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS)
    return {r.encounter_id: r for r in cohort.care_transitions(seq, "snf", READMIT, **options).collect()}


def test_transitions(encounters):
    t = transitions(encounters)
    assert sorted(t) == [11, 13, 21, 23, 30, 50]
    assert t[11].days_to_next_encounter == 30 and t[11].readmitted
    assert t[13].days_to_next_encounter == 31 and not t[13].readmitted
    assert t[21].from_setting == "emergency" and t[21].prev_encounter_id == 20
    assert t[21].to_setting == "snf" and not t[21].readmitted
    assert t[23].length_of_stay is None and t[23].readmitted is False
    assert t[30].days_to_next_encounter == -5 and t[30].readmitted
    assert not t[50].readmitted
    assert sorted(r.transition_id for r in t.values()) == [1, 2, 3, 4, 5, 6]


def test_modes(encounters):
    assert not transitions(encounters, min_gap_days=0)[30].readmitted
    t = transitions(encounters, mode="any_within", ids="hash")
    assert t[50].readmitted and t[11].readmitted and not t[13].readmitted and not t[30].readmitted
    assert len({r.transition_id for r in t.values()}) == 6
    with pytest.raises(ValueError):
        transitions(encounters, mode="other")


def test_hot_patients_change_nothing(encounters):
    plain = {k: tuple(v) for k, v in transitions(encounters).items()}
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS, min_rows=1)
    hot = cohort.care_transitions(seq, "snf", READMIT, min_rows=1)
    assert {r.encounter_id: tuple(r) for r in hot.collect()} == plain


def test_calendar_rules(spark):
    row = spark.sql("SELECT date'2023-12-31' AS b, timestamp'2024-01-01 00:01' AS e, timestamp'2023-12-31 23:59' AS s")
    got = row.select(
        age_years(F.col("b"), F.lit(date(2024, 1, 1))).alias("y"), age_years(F.col("b"), F.lit(date(2024, 1, 1)), exact=True).alias("x"),
        days("e", "s").alias("d"),
    ).first()
    assert tuple(got) == (1, 0, 1)


def test_cohort(spark, encounters):
    patients = spark.createDataFrame([(i, date(1950, 6, 1)) for i in range(1, 6)], "patient_id int, birthdate date")
    rows = {r.patient_id: r for r in cohort.patient_cohort(patients, encounters, "snf", date(2024, 1, 1)).collect()}
    assert sorted(rows) == [1, 2, 3, 5]
    assert rows[1].total_stays == 2 and rows[1].avg_los_days == 12.0 and rows[1].total_cost == 200.0 and rows[1].age == 74
    assert rows[2].avg_los_days == 1.0


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (1, "c1", "A00", at(-10), None),  # open
        (1, "c2", "A01", at(-10), at(6)),  # ends on the day of admission
        (1, "c3", "A02", at(-10), at(5)),  # ended before
        (1, "c4", "A03", at(20), at(30)),  # starts on the day of discharge
        (1, "c1", "A00", at(-10), None),  # a copy
        (3, "c5", "A05", at(21), None),  # starts after discharge
    ]
    return spark.createDataFrame(rows, "patient_id int, description string, code string, start_at timestamp, stop_at timestamp")


def test_profiles(spark, encounters, facts):
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS)
    stays = cohort.care_transitions(seq, "snf", READMIT)
    meds = facts.withColumn("reason", F.lit(None).cast("string"))
    allergies = facts.limit(0).withColumns({"category": F.lit("x"), "severity": F.lit("y")})
    for size in (5_000, 1):
        rows = cohort.transition_profiles(stays, facts, meds, allergies, part_size=size, min_rows=1).collect()
        by = {}
        for r in rows:
            assert r.active_conditions is not None and r.allergies == []
            by.setdefault(r.encounter_id, []).extend((x.code, x.copies) for x in r.active_conditions)
        assert sorted(by) == [11, 13, 21, 23, 30, 50]
        assert sorted(by[11]) == [("A00", 2), ("A01", 1), ("A03", 1)]
        assert by[13] == [("A00", 2)] and by[23] == [] and by[30] == []
    counts = {r.encounter_id: r.n_conditions for r in cohort.profile_counts(stays, facts, meds, allergies).collect()}
    assert counts == {11: 4, 13: 2, 21: 0, 23: 0, 30: 0, 50: 0}
    closed = cohort.close_open_stays(stays, F.lit(at(60)))
    assert closed.filter("encounter_id = 23").first().discharge_date == at(60)


def test_one_prompt_per_transition(spark, encounters, facts):
    """Profiles dealt over many parts give the prompts and documents of undivided ones."""
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS)
    stays = cohort.care_transitions(seq, "snf", READMIT)
    meds = facts.withColumn("reason", F.lit(None).cast("string"))
    allergies = facts.filter("code = 'A01'").withColumns({"category": F.lit("x"), "severity": F.lit("y")})
    people = spark.createDataFrame(
        [(i, f"P{i}", 70, "F") for i in range(1, 6)], "patient_id int, patient_name string, age int, gender string"
    )
    told = []
    for size in (5_000, 1):
        profiles = cohort.transition_profiles(stays, facts, meds, allergies, part_size=size)
        variables = narrative.prompt_variables(narrative.risk_tier(profiles), people)
        told.append(sorted(variables.collect(), key=lambda r: r.transition_id))
    assert told[0] == told[1] and len(told[0]) == 6
    assert any(r.allergies for r in told[1])
    prompts = narrative.render_prompts(spark.createDataFrame(told[1], variables.schema))
    assert prompts.count() == 6 * len(narrative.PROMPTS)


def test_no_nested_loop_and_one_pass_windows(encounters, facts):
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS)
    stays = cohort.care_transitions(seq, "snf", READMIT)
    for df in (cohort.active_facts(stays, facts), cohort.active_counts(stays, {"n": facts})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_timeline_and_history(encounters):
    pages = cohort.timeline_pages(encounters, page_size=2).filter("patient_id = 1").orderBy("page").collect()
    assert [[x.encounter_id for x in p.timeline] for p in pages] == [[10, 11], [12, 13], [14]]
    seq = cohort.encounter_sequence(encounters, cohort.cohort_ids(encounters, "snf"), SETTINGS)
    prior = cohort.prior_readmissions(cohort.care_transitions(seq, "snf", READMIT))
    assert {r.encounter_id: (r.prior_stays, r.prior_readmissions) for r in prior.collect()}[13] == (1, 1)


def test_profile_counts_read_the_lines_once(spark):
    """Conditions, medications and allergies come from one pass; without hot patients nothing is swept."""
    from transitus.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.profile_counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("l_linestatus") and sum("l_shipdate" in line and "Relation" in line for line in plan.splitlines()) == 1
    apart = cohort.profile_counts(t.transitions, t.conditions, t.medications, t.allergies)
    columns = ["transition_id", "n_conditions", "n_medications", "n_allergies"]
    assert sorted(t.profile_counts.select(columns).collect()) == sorted(apart.select(columns).collect())
    crowded = cohort.profile_counts(t.transitions, t.conditions, t.medications, t.allergies, 2, t.clinical)
    assert sorted(crowded.select(columns).collect()) == sorted(apart.select(columns).collect())


def test_recent_observations_read_the_lines_once(spark):
    from transitus.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = cohort.recent_observations(t.transitions, t.observations)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan


@pytest.mark.parametrize("size", [3, 5_000])
def test_profiles_from_one_table(spark, size):
    """Facts of all sorts in one table whose details are joined to what stays meet: the same profiles, in parts or whole."""
    from transitus.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    own = t.transitions, t.conditions, t.medications, t.allergies
    apart = cohort.transition_profiles(*own, part_size=size)
    joined = cohort.transition_profiles(*own, part_size=size, together=t.clinical)
    assert joined.columns == apart.columns and "l_shipdate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    held = ["transition_id", "part", "n_conditions", "active_conditions", "active_medications", "allergies"]
    key = lambda r: (r["transition_id"], r["part"])
    a, b = (sorted(df.select(held).collect(), key=key) for df in (apart, joined))
    assert (max(r["part"] for r in a) > 0) == (size == 3)
    if size == 5_000:
        assert a == b
    else:
        assert [r[:3] for r in a] == [r[:3] for r in b]
    whole = lambda df: sorted(map(str, narrative.whole_profiles(df).select("transition_id", *held[2:]).collect()))
    assert whole(apart) == whole(joined)
