"""Readmission model, forecasts, anomalies, drug pairs and survey readiness."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import n_rows, ratio
from transitus.functions.skew import exact_quantiles
from transitus.session import stage

FEATURES = ["n_conditions", "n_medications", "length_of_stay", "prior_readmissions"]
STEPS = 8
RIDGE = 0.01


@dataclass(frozen=True)
class Logit:
    """Weights (intercept first) for standardised features, with what replaces a gap."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]

    def inputs(self) -> list[Column]:
        rows = zip(self.features, self.medians, self.means, self.scales, strict=True)
        return [(F.coalesce(F.col(f).cast("double"), F.lit(gap)) - F.lit(mean)) / F.lit(scale) for f, gap, mean, scale in rows]

    def probability(self, inputs: Sequence[Column]) -> Column:
        total = F.lit(self.weights[0])
        for weight, value in zip(self.weights[1:], inputs, strict=True):
            total = total + F.lit(weight) * value
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def readmission_model(stays: DataFrame, before: date, features: list[str] = FEATURES) -> Logit:
    """Logistic regression on the stays admitted before a day; gaps in the features get the median.

    Reweighted least squares: each of `STEPS` steps is one aggregate over the stays (gradient and curvature, summed
    per partition first) and a system of as many equations as there are features, plus one. `RIDGE` on the standardised weights keeps
    the system solvable where a feature is constant or tells the classes apart. `stays` is read `STEPS` + 1 times: give
    a written table. Without a stay all weights are 0. Medians come from counts of equal values: features are counts
    and days, few of them different.
    """
    train = stays.filter(F.col("admission_date") < F.lit(before)).select(
        F.col("readmitted").cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]
    ).filter(F.col("_y").isNotNull())
    told = train.agg(F.count(F.lit(1)).alias("n"), *[c for i, f in enumerate(features) for c in (
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{f}`)").cast("double").alias(f"m{i}"),
        F.count(f).alias(f"c{i}"), F.sum(f).alias(f"s{i}"), F.sum(F.col(f) * F.col(f)).alias(f"q{i}"),
    )]).first()
    size = len(features)
    if not told.n:
        return Logit(tuple(features), (0.0,) * size, (0.0,) * size, (1.0,) * size, (0.0,) * (size + 1))
    medians, means, scales = [], [], []
    for i in range(size):
        gap, blank = told[f"m{i}"] or 0.0, told.n - told[f"c{i}"]
        mean = ((told[f"s{i}"] or 0.0) + gap * blank) / told.n
        spread = ((told[f"q{i}"] or 0.0) + gap * gap * blank) / told.n - mean * mean
        medians.append(gap)
        means.append(mean)
        scales.append(math.sqrt(spread) if spread > 0 else 1.0)
    model = Logit(tuple(features), tuple(medians), tuple(means), tuple(scales), (0.0,) * (size + 1))
    data = train.select("_y", F.lit(1.0).alias("_x0"), *[c.alias(f"_x{i + 1}") for i, c in enumerate(model.inputs())])
    ridge = np.diag([0.0] + [RIDGE * told.n] * size)
    pairs = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    for _ in range(STEPS):
        guess = data.withColumn("_p", model.probability([F.col(f"_x{i + 1}") for i in range(size)]))
        sums = guess.agg(
            *[F.sum((F.col("_y") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(size + 1)],
            *[F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        weights, curve = np.array(model.weights), np.zeros((size + 1, size + 1))
        for i, j in pairs:
            curve[i, j] = curve[j, i] = sums[f"h{i}_{j}"]
        slope = np.array([sums[f"g{i}"] for i in range(size + 1)]) - ridge @ weights
        weights = weights + np.linalg.solve(curve + ridge, slope)
        model = replace(model, weights=tuple(weights.tolist()))
    return model


def score_readmission(model: Logit, stays: DataFrame, since: date) -> DataFrame:
    """Probability of readmission for the stays admitted from a day on."""
    rows = stays.filter(F.col("admission_date") >= F.lit(since))
    return rows.select("transition_id", "readmitted", model.probability(model.inputs()).alias("probability"))


def forecast_los_cost(stays: DataFrame, by: list[str]) -> DataFrame:
    """Monthly length of stay and cost per series, with two forecasts made from earlier months only.

    `recent_*` is the mean over all stays of the last three calendar months, `seasonal_*` the value twelve months
    before. The last row of each series lies one month ahead and has no actual value.
    """
    monthly = stays.groupBy(*by, F.to_date(F.trunc("admission_date", "month")).alias("month")).agg(
        n_rows().alias("stays"), F.sum("length_of_stay").alias("_days"), F.count("length_of_stay").alias("_closed"),
        F.sum("total_cost").alias("_cost"),
    )
    span = monthly.groupBy(*by).agg(F.min("month").alias("_a"), F.add_months(F.max("month"), 1).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month"))
    # one row per series and month
    past = Window.partitionBy(*by).orderBy("month").rowsBetween(-3, -1)
    year = Window.partitionBy(*by).orderBy("month").rowsBetween(-12, -12)
    rows = grid.join(monthly, [*by, "month"], "left").withColumns(
        {"los": ratio(F.col("_days"), F.col("_closed")), "cost": ratio(F.col("_cost"), F.col("stays"))}
    )
    return rows.select(
        *by, "month", F.coalesce("stays", F.lit(0)).cast("bigint").alias("stays"), "los", "cost",
        ratio(F.sum("_days").over(past), F.sum("_closed").over(past)).alias("recent_los"),
        ratio(F.sum("_cost").over(past), F.sum("stays").over(past)).alias("recent_cost"),
        F.max("los").over(year).alias("seasonal_los"), F.max("cost").over(year).alias("seasonal_cost"),
    )


def claim_anomalies(claims: DataFrame, value: str, above: float = 3.5, width: float = 100.0) -> DataFrame:
    """Claims far from their payer's median, by the robust z-score on the median absolute deviation."""
    middle = exact_quantiles(claims, ["payer"], value, {"_median": 0.5}, width)
    # one row per payer: well below the broadcast limit whatever the number of claims
    away = claims.join(F.broadcast(middle), "payer").withColumn("_away", F.abs(F.col(value) - F.col("_median")))
    spread = exact_quantiles(away, ["payer"], "_away", {"_mad": 0.5}, width)
    score = F.lit(0.6745) * (F.col(value) - F.col("_median")).cast("double") / F.nullif(F.col("_mad").cast("double"), F.lit(0.0))
    return (
        away.join(F.broadcast(spread), "payer").withColumn("robust_z", score)
        .filter(F.abs("robust_z") > above).drop("_away", "_median", "_mad")
    )


def rare_med_pairs(held: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Support and lift of drug-class pairs held together.

    Holders with the same set of classes are merged first, and pairs are formed once per distinct set. The
    classes are a fixed vocabulary, which bounds a set and its pairs.
    """
    sets = (
        held.select(key, "code").join(classes, "code").select(key, "drug_class").distinct()
        .groupBy(key).agg(F.array_sort(F.collect_list("drug_class")).alias("_set"))
        .groupBy("_set").agg(n_rows().alias("_n"))
    )
    single = sets.select(F.explode("_set").alias("c"), "_n").groupBy("c").agg(F.sum("_n").alias("_s"))
    pairs = F.flatten(F.transform("_set", lambda a, i: F.transform(
        F.slice("_set", i + 2, F.size("_set")), lambda b: F.struct(a.alias("class_a"), b.alias("class_b"))
    )))
    together = sets.select("_n", F.inline(pairs)).groupBy("class_a", "class_b").agg(F.sum("_n").cast("bigint").alias("together"))
    holders = sets.agg(F.sum("_n")).scalar()
    return (
        together.join(single.select(F.col("c").alias("class_a"), F.col("_s").alias("_a")), "class_a")
        .join(single.select(F.col("c").alias("class_b"), F.col("_s").alias("_b")), "class_b")
        .select(
            "class_a", "class_b", "together", ratio(F.col("together"), holders).alias("support"),
            (F.col("together").cast("double") * holders.cast("double") / (F.col("_a") * F.col("_b")).cast("double")).alias("lift"),
        )
    )


def unexpected_med_sets(held: DataFrame, classes: DataFrame, key: str, min_count: int = 5, min_z: float = 3.0) -> DataFrame:
    """Pairs and triples of drug classes that holders have together far more or less often than expected.

    A pair is expected as often as its classes would meet if they were independent, a triple as often as its three
    pairs and classes foretell (p_ab * p_ac * p_bc / (p_a * p_b * p_c)), so that a triple is not listed for what a pair
    in it explains. `z` is the distance in standard deviations of a count with that share; at least `min_z` on either
    side is listed. Sets grow by one class at a time behind their last one, and only pairs held `min_count` times grow.
    Holders with the same classes are merged first. Null classes and unknown codes count for nothing.
    """
    sets = (
        held.select(key, "code").join(classes, "code").filter(F.col("drug_class").isNotNull()).select(key, "drug_class").distinct()
        .groupBy(key).agg(F.array_sort(F.collect_list("drug_class")).alias("_set"))
        .groupBy("_set").agg(n_rows().alias("_n"))
    )
    sets = stage(sets, "drug-sets")
    holders = sets.agg(F.sum("_n")).scalar().cast("double")

    def grown(states: DataFrame, names: list[str], new: str) -> DataFrame:
        """Each state with each later class of its set; `_rest` holds what comes after the last one."""
        return states.select(*names, "_n", "_rest", F.posexplode("_rest").alias("_i", new)).select(
            *names, new, "_n", F.slice("_rest", F.col("_i") + 2, F.size("_rest")).alias("_rest")
        )

    def counted(states: DataFrame, names: list[str]) -> DataFrame:
        return states.groupBy(*names).agg(F.sum("_n").cast("bigint").alias("together")).filter(F.col("together") >= min_count)

    def share(counts: DataFrame, names: list[str], name: str) -> DataFrame:
        return counts.select(*[F.col(old).alias(new) for old, new in zip(counts.columns, names)], (F.col("together") / holders).alias(name))

    ones = grown(sets.withColumnRenamed("_set", "_rest"), [], "class_a")
    single = counted(ones, ["class_a"])
    twos = grown(ones, ["class_a"], "class_b")
    pairs = stage(counted(twos, ["class_a", "class_b"]), "drug-pairs")
    threes = grown(twos.join(pairs.drop("together"), ["class_a", "class_b"], "left_semi"), ["class_a", "class_b"], "class_c")
    triples = counted(threes, ["class_a", "class_b", "class_c"])
    for c in "abc":
        triples = triples.join(share(single, [f"class_{c}"], f"_{c}"), f"class_{c}")
    for x, y in ("ab", "ac", "bc"):
        triples = triples.join(share(pairs, [f"class_{x}", f"class_{y}"], f"_{x}{y}"), [f"class_{x}", f"class_{y}"])
    for c in "ab":
        pairs = pairs.join(share(single, [f"class_{c}"], f"_{c}"), f"class_{c}")
    p2 = F.col("_a") * F.col("_b")
    p3 = F.least(F.lit(1.0), F.col("_ab") * F.col("_ac") * F.col("_bc") / (p2 * F.col("_c")))
    met = pairs.select("class_a", "class_b", F.lit(None).cast("string").alias("class_c"), "together", p2.alias("_p")).unionByName(
        triples.select("class_a", "class_b", "class_c", "together", p3.alias("_p"))
    )
    expected = F.col("_p") * holders
    z = (F.col("together") - expected) / F.nullif(F.sqrt(expected * (1 - F.col("_p"))), F.lit(0.0))
    return met.select("class_a", "class_b", "class_c", "together", expected.alias("expected"), z.alias("z")).filter(F.abs("z") >= min_z)


def survey_readiness(deficiencies: DataFrame, weights: dict[str, int], start: int = 100) -> DataFrame:
    """Score per facility and day on which it changes: `start` less the weights of the open deficiencies.

    The formula is ours. Each deficiency weighs from its survey day until the day it is corrected; changes are
    summed per facility and day before the ordered pass.
    """
    weight = F
    for severity, w in weights.items():
        weight = weight.when(F.col("severity") == severity, w)
    changes = deficiencies.select("organization_id", weight.otherwise(0).alias("_w"), "survey_date", "corrected_at").select(
        "organization_id",
        F.inline(F.array(
            F.struct(F.to_date("survey_date").alias("day"), F.col("_w").alias("_d"), F.lit(1).alias("_open")),
            F.struct(F.to_date("corrected_at").alias("day"), (-F.col("_w")).alias("_d"), F.lit(-1).alias("_open")),
        )),
    ).filter(F.col("day").isNotNull())
    upto = Window.partitionBy("organization_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        changes.groupBy("organization_id", "day").agg(F.sum("_d").alias("_d"), F.sum("_open").alias("_open"))
        .select("organization_id", "day", (F.lit(start) - F.sum("_d").over(upto)).cast("bigint").alias("score"),
                F.sum("_open").over(upto).cast("bigint").alias("open_deficiencies"))
    )
