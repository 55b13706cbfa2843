"""Denial risk: the sums per encounter are dealt over tasks of their own and equal a plain count."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from transitus.operators import denial

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    encounters = [(k % 37, draw.choice(["A", "B", None])) for k in range(40)] + [(None, "A")]
    lines = [
        (draw.choice([0, 0, 0, *range(45), None]), draw.choice(["x", "y", "z", None]), DAY, DAY + timedelta(days=draw.randint(0, 120)),
         Decimal(draw.randint(0, 5000)), draw.choice([None, Decimal(0), Decimal(draw.randint(0, 90))]))
        for _ in range(600)
    ]
    return encounters, lines


def plain(encounters, lines):
    per = defaultdict(list)
    for encounter, diagnosis, served, billed, charge, unpaid in lines:
        per[encounter, diagnosis].append((charge, unpaid, unpaid is not None and unpaid > 0 and (billed - served).days > 60))
    groups = defaultdict(list)
    for (encounter, diagnosis), own in per.items():
        for one, payer in encounters:
            if one is not None and one == encounter:
                groups[payer, diagnosis].append(own)
    out = set()
    for by, found in groups.items():
        every = [line for own in found for line in own]
        unpaid = [u for _, u, _ in every if u is not None]
        out.add((*by, len(found), sum(any(d for *_, d in own) for own in found) * 100.0 / len(found), float(sum(c for c, *_ in every)),
                 float(sum(unpaid)) if unpaid else None, sum(d for *_, d in every) * 100.0 / len(every)))
    return out


@pytest.mark.parametrize("tasks", [2, 5, denial.TASKS])
def test_denial_risk_is_dealt_over_tasks(spark, rows, tasks):
    encounters = spark.createDataFrame(rows[0], "encounter_id int, payer string")
    lines = spark.createDataFrame(
        rows[1], "encounter_id int, diagnosis string, service_at date, billed_at date, charge decimal(18,2), outstanding decimal(24,4)"
    )
    # as in the binding, lines come out of a join by encounter, whose tasks would else hold the sums as well
    lines = lines.join(spark.range(50).select(F.col("id").cast("int").alias("encounter_id")).hint("merge"), "encounter_id")
    risk = denial.denial_risk(lines, encounters, ["payer", "diagnosis"], tasks=tasks)
    assert {tuple(r) for r in risk.collect()} == plain(*rows)
    assert f", {tasks}), REPARTITION_BY_NUM" in risk._jdf.queryExecution().executedPlan().toString()
