import pytest
from pyspark.sql import functions as F

from transitus.operators import medrec, models, narrative


@pytest.fixture(scope="module")
def held(spark):
    rows = [(1, "w", "warfarin"), (1, "i", "ibuprofen"), (1, "i", "ibuprofen"), (1, "n", "naproxen"), (2, "w", "warfarin"), (2, "g", "glargine"), (3, "i", "ibuprofen")]
    return spark.createDataFrame(rows, "pid int, code string, description string")


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([("w", "anticoagulant"), ("i", "nsaid"), ("n", "nsaid"), ("g", "insulin")], "code string, drug_class string")


def test_interactions(held, classes):
    got = {(r.pid, r.side, r.code) for r in medrec.drug_interactions(held, classes, "pid").collect()}
    assert got == {(1, "A", "w"), (1, "B", "i"), (1, "B", "n")}


def test_allergies_duplicates_alerts_gaps(spark, held, classes):
    allergies = spark.createDataFrame([(1, "n", "SEVERE"), (2, "i", "MILD")], "pid int, code string, severity string")
    assert {(r.pid, r.code) for r in medrec.allergy_conflicts(held, allergies, classes, "pid").collect()} == {(1, "i"), (1, "n")}
    assert [(r.pid, r.drug_class, r.n_drugs) for r in medrec.duplicate_therapy(held, classes, "pid").collect()] == [(1, "nsaid", 2)]
    assert {(r.pid, r.code) for r in medrec.high_alert_meds(held, classes, "pid").collect()} == {(1, "w"), (2, "w"), (2, "g")}
    conditions = spark.createDataFrame([(1, "E11", "diabetes"), (2, "E11", "diabetes"), (1, "X", "other")], "pid int, code string, description string")
    groups = spark.createDataFrame([("E11", "endocrine")], "code string, category string")
    gaps = medrec.therapy_gaps(conditions, held, classes, groups, [("endocrine", "insulin")], "pid")
    assert [(r.pid, r.code) for r in gaps.collect()] == [(1, "E11")]


def test_pairs(held, classes):
    got = {(r.class_a, r.class_b): (r.together, round(r.lift, 4)) for r in models.rare_med_pairs(held, classes, "pid").collect()}
    assert got == {("anticoagulant", "nsaid"): (1, 0.75), ("anticoagulant", "insulin"): (1, 1.5)}


def test_generation_goes_on_after_errors(spark):
    def flaky():
        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no answer")
            return [t.upper() for t in texts]

        return run

    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "b")], "transition_id int, prompt string").withColumn("section", F.lit("s"))
    out = narrative.batch_generate(prompts, flaky, "m", batch=10, tasks=1)
    rows = {r.output: r.error for r in out.collect()}
    assert rows == {"A": None, "B": None, None: "RuntimeError: no answer"}
    assert narrative.batch_generate(prompts, flaky, "m", done=out).count() == 1
    assert narrative.attach_outputs(prompts, out, None).filter("output = 'A'").count() == 2


def test_missing_values_never_empty_a_prompt(spark):
    row = spark.sql("SELECT cast(null AS string) AS allergies, 'x' AS patient_name")
    text = row.select(narrative.fill("{patient_name}: {allergies}.", narrative.FALLBACKS["clinical_handoff"]).alias("t")).first().t
    assert text == "x: No known allergies."


def test_rules_of_any_size(spark, monkeypatch):
    """Literals, a list too long to broadcast and a table give the same rows."""
    from transitus.functions import columns

    rows, schema = [("a", 1), ("b", 2)], "name string, n int"
    held = spark.createDataFrame([(*r, "x") for r in rows], schema + ", more string")
    short = columns.rules(spark, rows, schema)
    monkeypatch.setattr(columns, "RULE_ROWS", 1)
    assert sorted(short.collect()) == sorted(columns.rules(spark, rows, schema).collect()) == sorted(columns.rules(spark, held, schema).collect())


def test_unexpected_sets(spark):
    """Triples against all sets counted in plain Python; a triple that its pairs explain is not listed."""
    import itertools
    import random

    rng = random.Random(5)
    held = []
    for holder in range(600):
        classes = {c for c in "ABCDEF" if rng.random() < 0.5}
        if holder % 2:
            classes = classes | {"B"} if "A" in classes else classes - {"B"}
        # any two of D, E and F are independent, the three together are not
        classes = classes - {"F"} if ("D" in classes) != ("E" in classes) else classes | {"F"}
        held += [(holder, c.lower()) for c in classes] * 2
    held += [(1, "unknown"), (2, None)]
    codes = spark.createDataFrame([(c.lower(), c) for c in "ABCDEF"] + [("unknown", None)], "code string, drug_class string")
    got = {
        (r.class_a, r.class_b, r.class_c): (r.together, round(r.expected, 6), round(r.z, 6))
        for r in models.unexpected_med_sets(spark.createDataFrame(held, "pid int, code string"), codes, "pid", 5, 2.5).collect()
    }
    sets = {}
    for holder, code in held:
        if code and code != "unknown":
            sets.setdefault(holder, set()).add(code.upper())
    n = len(sets)
    p = {k: sum(set(k) <= s for s in sets.values()) / n for size in (1, 2, 3) for k in itertools.combinations("ABCDEF", size)}
    want = {}
    for k in p:
        if len(k) == 1 or round(p[k] * n) < 5:
            continue
        share = 1.0
        for one in k:
            share *= p[(one,)]
        if len(k) == 3:
            a, b, c = k
            share = min(1.0, p[a, b] * p[a, c] * p[b, c] / share)
        z = (p[k] * n - share * n) / (share * n * (1 - share)) ** 0.5
        if abs(z) >= 2.5:
            want[(*k, None)[:3]] = (round(p[k] * n), round(share * n, 6), round(z, 6))
    assert got == want and ("A", "B", None) in got and any(k[2] for k in got)


def test_readmission_model(spark):
    """Weights at the optimum: the gradient of the penalised likelihood vanishes; gaps and constants do no harm."""
    import random
    from datetime import date, timedelta

    import numpy as np

    rng = random.Random(2)
    rows = []
    for i in range(800):
        x, y = rng.randint(0, 9), rng.choice([None, 1, 2, 5])
        rows.append((i, date(1999, 1, 1) + timedelta(days=i), rng.random() < 1 / (1 + 2.7 ** (3 - x)), x, y, 7))
    stays = spark.createDataFrame(rows, "transition_id int, admission_date date, readmitted boolean, x int, y int, z int")
    model = models.readmission_model(stays, date(2000, 1, 1), ["x", "y", "z"])
    train = [r for r in rows if r[1] < date(2000, 1, 1)]
    values = np.array([[r[3], 2 if r[4] is None else r[4], 7] for r in train], dtype=float)
    assert model.medians == (float(sorted(r[3] for r in train)[(len(train) + 1) // 2 - 1]), float(model.medians[1]), 7.0)
    values[:, 1] = [model.medians[1] if r[4] is None else r[4] for r in train]
    inputs = np.c_[np.ones(len(train)), (values - model.means) / model.scales]
    weights = np.array(model.weights)
    p = 1 / (1 + np.exp(-inputs @ weights))
    slope = inputs.T @ (np.array([r[2] for r in train]) - p) - models.RIDGE * len(train) * np.r_[0, weights[1:]]
    assert np.abs(slope).max() < 1e-8 and model.weights[1] > 1
    assert models.score_readmission(model, stays, date(2000, 1, 1)).count() == len(rows) - len(train)
    blank = models.readmission_model(stays, date(1990, 1, 1), ["x", "y", "z"])
    assert {r.probability for r in models.score_readmission(blank, stays, date(2000, 1, 1)).collect()} == {0.5}
