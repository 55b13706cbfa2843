"""Case-mix reimbursement: classification, daily rates, coding gaps and their value.

Rate tables, code maps and qualifying lists are inputs; none is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import count_if, days, n_rows, pct, ratio, rules, total
from transitus.functions.phrases import phrase_hits
from transitus.functions.skew import exact_quantiles
from transitus.functions.text import SENTENCE_END, words
from transitus.operators.approval import Machine, fold

# Fixed value: letter, two characters, optional dot and up to four more.
CODE_PATTERN = r"\b([A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?)\b"
UNDERCODED_ABOVE = 100.0


def normal_code(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))


def clinical_category(conditions: DataFrame, code_map: DataFrame) -> DataFrame:
    """(patient_id, clinical_category): category of the earliest mapped condition."""
    return (
        conditions.select("patient_id", "code", "start_at").join(code_map.select("code", "category"), "code")
        .groupBy("patient_id").agg(F.min_by("category", F.struct("start_at", "code")).alias("clinical_category"))
    )


def comorbidity_count(conditions: DataFrame, qualifying: DataFrame) -> DataFrame:
    """(patient_id, n_comorbidities, comorbidity_class 0/1/2) over distinct qualifying codes; patients with none are left out."""
    return (
        conditions.select("patient_id", "code").join(qualifying.select("code").distinct(), "code", "left_semi")
        .groupBy("patient_id").agg(F.count_distinct("code").cast("bigint").alias("n_comorbidities"))
        .withColumn("comorbidity_class", F.least("n_comorbidities", F.lit(2)).cast("bigint"))
    )


def nta_services(procedures: DataFrame, medications: DataFrame, service_map: DataFrame) -> DataFrame:
    """(patient_id, service, n): ancillary services found in procedures and medications."""
    items = procedures.select("patient_id", "code").unionAll(medications.select("patient_id", "code"))
    return items.join(service_map.select("code", "service"), "code").groupBy("patient_id", "service").agg(n_rows().alias("n"))


def component_classes(
    patients: DataFrame, category: DataFrame, comorbidity: DataFrame, services: DataFrame,
    nursing_rules: list[tuple[str, int, str]], function_score: Column,
) -> DataFrame:
    """Patients with their nursing, ancillary and therapy class.

    Nursing A–E from (category, comorbidity class); ancillary A–F from the number of services, five or more
    being the highest; therapy A–D from the function score in quarters of 0–24, 24 being in the last. A patient
    without a score, or with one outside 0–24, has no therapy class.
    """
    nursing = rules(patients.sparkSession, nursing_rules, "clinical_category string, comorbidity_class bigint, nursing_class string")
    counts = services.groupBy("patient_id").agg(n_rows().alias("n_services"))
    place = F.coalesce("n_services", F.lit(0))
    return (
        patients.join(category, "patient_id", "left").join(comorbidity, "patient_id", "left").join(counts, "patient_id", "left")
        .withColumn("comorbidity_class", F.coalesce("comorbidity_class", F.lit(0)).cast("bigint"))
        .join(nursing, ["clinical_category", "comorbidity_class"], "left")
        .select(
            "patient_id", "clinical_category", "comorbidity_class", F.coalesce("n_services", F.lit(0)).cast("bigint").alias("n_services"),
            F.coalesce("nursing_class", F.lit("A")).alias("nursing_class"),
            F.substring(F.lit("ABCDEF"), F.least(place, F.lit(5)).cast("int") + 1, F.lit(1)).alias("nta_class"),
            F.when(
                function_score.between(0, 24),
                F.substring(F.lit("ABCD"), F.least(F.floor(function_score / 6), F.lit(3)).cast("int") + 1, F.lit(1)),
            ).alias("therapy_class"),
        )
    )


THERAPIES = ["PT", "OT", "SLP"]


def optimal_daily_rate(classes: DataFrame, rates: list[tuple[str, str, float]], non_case_mix: float) -> DataFrame:
    """Daily rate = PT + OT + SLP + nursing + ancillaries + the part that does not depend on the case mix.

    Null where a component has no class or its class no rate.
    """
    table = rules(
        classes.sparkSession, rates, "component string, class string, rate double"
    ).withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    parts = F.array(
        F.struct(F.lit("NURSING").alias("component"), F.col("nursing_class").alias("class")),
        F.struct(F.lit("NTA").alias("component"), F.col("nta_class").alias("class")),
        *[F.struct(F.lit(t).alias("component"), F.col("therapy_class").alias("class")) for t in THERAPIES],
    )
    sums = (
        classes.select("patient_id", F.inline(parts)).join(F.broadcast(table), ["component", "class"], "left")
        .groupBy("patient_id")
        .agg(F.when(F.count("rate") == n_rows(), F.sum("rate")).alias("_rate"))
    )
    return sums.select("patient_id", (F.col("_rate") + F.lit(non_case_mix).cast("decimal(18,2)")).cast("double").alias("optimal_rate"))


def actual_daily_rate(encounters: DataFrame) -> DataFrame:
    """(patient_id, n_days, cost, actual_rate) over closed stays; stays of no days have no rate."""
    n_days = days("stop_at", "start_at")
    return encounters.filter(F.col("stop_at").isNotNull()).groupBy("patient_id").agg(
        F.sum(n_days).cast("bigint").alias("n_days"), total("total_cost").alias("cost"),
        ratio(F.sum("total_cost"), F.sum(n_days)).alias("actual_rate"),
    )


def undercoded(optimal: DataFrame, actual: DataFrame, above: float = UNDERCODED_ABOVE) -> DataFrame:
    """Optimal against actual daily rate; `undercoded` where the gap exceeds `above`."""
    return optimal.join(actual, "patient_id").withColumn("daily_gap", F.col("optimal_rate") - F.col("actual_rate")).withColumn(
        "undercoded", F.coalesce(F.col("daily_gap") > above, F.lit(False))
    )


def missed_codes(conditions: DataFrame, assessed: DataFrame) -> DataFrame:
    """Codes a patient has that the assessment lacks; `refines` where only a broader or sister code is assessed."""
    have = conditions.select("patient_id", "code", normal_code("code").alias("_n")).distinct()
    coded = assessed.select("patient_id", normal_code("code").alias("_n")).distinct()
    family = coded.select("patient_id", F.substring("_n", 1, 3).alias("_f")).distinct().withColumn("_hit", F.lit(True))
    return (
        have.join(coded, ["patient_id", "_n"], "left_anti").withColumn("_f", F.substring("_n", 1, 3))
        .join(family, ["patient_id", "_f"], "left")
        .select("patient_id", "code", F.coalesce("_hit", F.lit(False)).alias("refines"))
    )


def extract_codes(docs: DataFrame, dictionary: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Distinct codes written in a text that the dictionary knows; case as written, whole text."""
    found = docs.select(
        *key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(1)))).alias("code")
    ).distinct()
    return found.join(dictionary.select("code").distinct(), "code", "left_semi").select(*key, "code")


# What follows one of these words in its clause is absent or a relative's. Commas part the items of a list, so they
# end a clause only before a word that asserts something.
NEGATED = r"\b(?:denies|denied|no|not|without|negative for|family history)\b"
CLAUSE_END = r";|\b(?:but|however|although|though|except)\b|,\s*(?:and\s+)?(?:has|reports|known|positive for)\b"
NEGATED_PART = rf"(?i){NEGATED}.*?(?={CLAUSE_END}|$)"
# Stands for a part left out, so that no phrase reaches across it.
LEFT_OUT = " 0negated0 "

# (name, pattern with one number, lowest value, code): findings that a measurement shows.
MEASURES = [
    ("obesity", r"(?i)\bBMI\s+([0-9]+(?:\.[0-9]+)?)", 30.0, "E66.9"),
    ("moderate depression", r"(?i)\bPHQ-9\s+(?:score\s+)?([0-9]+)", 10.0, "F32.1"),
    ("osteoporosis", r"(?i)\bT-score\s+-([0-9]+(?:\.[0-9]+)?)", 2.5, "M81.0"),
]


# Stands for a measured finding among the phrases; no word of a text has this character.
MEASURED = "="


def note_sentences(notes: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Sentences with `stated`, their words without what is negated; a full stop inside a number does not end one.

    A sentence that a key's notes repeat comes as often as they do.
    """
    joined = F.regexp_replace(F.col(text), r"(\d)\.(\d)", "$1\u0001$2")
    # the outer form infers no filter, for which each text would be split twice
    split = notes.select(*key, F.explode_outer(F.split(joined, SENTENCE_END)).alias("sentence"))
    said = split.filter(F.trim("sentence") != "").select(*key, F.replace(F.trim("sentence"), F.lit("\u0001"), F.lit(".")).alias("sentence"))
    return said.withColumn("stated", F.regexp_replace("sentence", NEGATED_PART, LEFT_OUT))


def measured(measures: list[tuple], marks: list[Column]) -> Column:
    """Array of those `marks` whose measure, the one at the same place, shows in `stated`."""
    return F.array_compact(F.array(*[
        F.when(F.col("stated").rlike(pattern) & (F.regexp_extract("stated", pattern, 1).try_cast("double") >= lowest), mark)
        for (_, pattern, lowest, _), mark in zip(measures, marks, strict=True)
    ]))


def note_terms(
    notes: DataFrame, synonyms: DataFrame, longest: int, key: list[str], measures: list[tuple] = MEASURES, text: str = "text"
) -> DataFrame:
    """What `extract_terms` and `measured_terms` find, distinct, with the notes read once."""
    names = [f"{MEASURED}{i}" for i in range(len(measures))]
    # such a phrase has no place in a text
    table = synonyms.filter(~F.col("phrase").startswith(MEASURED)).select("phrase", "code", F.col("phrase").alias("_name"))
    told = note_sentences(notes, key, text)
    columns = [*key, "sentence", words("stated").alias("_words")]
    if measures:
        rows = F.array(*[
            F.struct(F.lit(mark).alias("phrase"), F.lit(code).alias("code"), F.lit(name).alias("_name"))
            for mark, (name, _, _, code) in zip(names, measures, strict=True)
        ])
        table = table.unionByName(notes.sparkSession.range(1).select(F.inline(rows)))
        columns.append(measured(measures, [F.lit(n) for n in names]).alias("_measured"))
    hits = phrase_hits(
        told.select(*columns), [*key, "sentence"], "_words", table, "phrase", longest, "_measured" if measures else None
    )
    return hits.select(*key, "code", F.col("_name").alias("phrase"), "sentence").distinct()


def extract_terms(notes: DataFrame, synonyms: DataFrame, longest: int, key: list[str], text: str = "text") -> DataFrame:
    """(key, code, phrase, sentence) for dictionary phrases of up to `longest` words that no negation precedes in its clause.

    `synonyms` is (phrase, code) in lower case. Phrases must stand within one sentence.
    """
    return note_terms(notes, synonyms, longest, key, [], text)


def measured_terms(notes: DataFrame, key: list[str], measures: list[tuple] = MEASURES, text: str = "text") -> DataFrame:
    """(key, code, phrase, sentence) for findings shown by a number in the sentence, unless a negation precedes it in its clause."""
    marks = [F.struct(F.lit(code).alias("code"), F.lit(name).alias("phrase")) for name, _, _, code in measures]
    found = F.inline(measured(measures, marks))
    return note_sentences(notes, key, text).select(*key, "sentence", found).select(*key, "code", "phrase", "sentence").distinct()


def note_gaps(terms: DataFrame, assessed: DataFrame, impact: DataFrame) -> DataFrame:
    """Terms of the notes not on the assessment, with component, daily value and one sentence as evidence.

    `impact` is (code, component, daily_value); a code that it does not list is a gap with neither.
    """
    coded = assessed.select("patient_id", normal_code("code").alias("_n")).distinct()
    return (
        terms.groupBy("patient_id", "code").agg(F.min("sentence").alias("evidence"), n_rows().alias("mentions"))
        .withColumn("_n", normal_code("code"))
        .join(coded, ["patient_id", "_n"], "left_anti").drop("_n")
        .join(impact, "code", "left")
    )


def discharge_gap(found: DataFrame, assessed: DataFrame, impact: DataFrame, los_days: int = 21) -> DataFrame:
    """Per patient: codes of the discharge text not assessed, their daily value and its sum over the stay.

    Within one component only the best code counts. Codes without a value are counted and add none.
    """
    gaps = missed_codes(found, assessed).join(impact, "code", "left")
    best = gaps.groupBy("patient_id", "component").agg(F.max("daily_value").alias("_best"), n_rows().alias("_codes"))
    return best.groupBy("patient_id").agg(
        F.sum("_codes").cast("bigint").alias("missed"), total("_best").alias("daily_gap"),
        total(F.col("_best") * los_days).alias("projected_recovery"),
    )


def revenue_impact(gaps: DataFrame, facilities: DataFrame) -> DataFrame:
    """Gap per facility, per chain and over all; `level` 0 facility, 1 chain, 3 all. `gaps` has organization_id, daily_gap."""
    return (
        gaps.join(facilities.select("organization_id", "chain"), "organization_id")
        .rollup("chain", "organization_id")
        .agg(F.grouping_id().cast("bigint").alias("level"), n_rows().alias("patients"), F.sum("daily_gap").cast("double").alias("daily_gap"))
    )


def scenario(admissions: DataFrame, cases: list[tuple[str, float, float]]) -> DataFrame:
    """Yearly value per facility and case (name, share of admissions undercoded, gap per admission)."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(share).alias("_share"), F.lit(gap).alias("_gap")) for n, share, gap in cases
    ])
    return admissions.select("organization_id", "admissions", F.inline(rows)).select(
        "organization_id", "scenario", (F.col("admissions") * F.col("_share")).alias("undercoded"),
        (F.col("admissions") * F.col("_share") * F.col("_gap")).alias("yearly_value"),
    )


RECOMMENDATION = Machine(
    states=["PENDING", "ACCEPTED", "DISMISSED"],
    moves={("PENDING", "ACCEPTED"): "ACCEPTED", ("PENDING", "DISMISSED"): "DISMISSED", ("DISMISSED", "REOPENED"): "PENDING"},
    stays=[(s, "VIEWED") for s in ("PENDING", "ACCEPTED", "DISMISSED")],
    marks={"accepted": ["ACCEPTED"], "dismissed": ["DISMISSED"]},
)


def recommendation_state(events: DataFrame) -> DataFrame:
    """(recommendation_id, status, reviewed_by, reviewed_at) from events (at, id, action, actor, role)."""
    last = F.greatest("accepted", "dismissed")
    return fold(events, RECOMMENDATION, "recommendation_id").select(
        "recommendation_id", "status", last["actor"].alias("reviewed_by"), last["at"].alias("reviewed_at"), "n_illegal"
    )


def coding_recommendations(gaps: DataFrame, analysis: str, los_days: int = 21) -> DataFrame:
    """One recommendation per patient: missed codes, their daily value and the value over the stay.

    The array holds distinct codes, so the code system bounds it.
    """
    return gaps.groupBy("patient_id").agg(
        F.array_sort(F.collect_set("code")).alias("recommended_additions"),
        F.count_distinct("code").cast("bigint").alias("n_codes"),
        total("daily_value").alias("daily_revenue_gap"),
        total(F.col("daily_value") * los_days).alias("total_revenue_opportunity"),
        F.min("evidence").alias("evidence"),
    ).withColumn("analysis_type", F.lit(analysis)).withColumn("recommendation_id", F.col("patient_id"))


def recovery_trend(recommendations: DataFrame, state: DataFrame) -> DataFrame:
    """Accepted value per month and the change to the month before that has any."""
    by_month = Window.partitionBy(F.lit(1)).orderBy("month")
    return (
        state.filter("status = 'ACCEPTED'").select("recommendation_id", F.date_format("reviewed_at", "yyyy-MM").alias("month"))
        .join(recommendations.select("recommendation_id", F.col("total_revenue_opportunity").cast("decimal(18,2)").alias("_v")), "recommendation_id")
        .groupBy("month").agg(n_rows().alias("accepted"), F.sum("_v").alias("_value"))
        .select("month", "accepted", F.col("_value").cast("double").alias("recovered"),
                (F.col("_value") - F.lag("_value").over(by_month)).cast("double").alias("change"))
    )


def coding_profile(assessed: DataFrame, gaps: DataFrame, services: DataFrame, benchmark_rate: float) -> DataFrame:
    """One row: share of patients with three or more codes, share with a service, rates against the benchmark."""
    codes = assessed.groupBy("patient_id").agg(F.count_distinct("code").alias("_codes"))
    nta = services.select("patient_id").distinct().withColumn("_nta", F.lit(True))
    rows = gaps.join(codes, "patient_id", "left").join(nta, "patient_id", "left")
    rate = F.col("actual_rate")
    return rows.agg(
        n_rows().alias("patients"),
        pct(count_if(F.col("_codes") >= 3), n_rows()).alias("pct_three_or_more"),
        pct(count_if(F.col("_nta")), n_rows()).alias("pct_with_service"),
        F.round(F.min(rate), 2).alias("lowest_rate"), F.round(F.max(rate), 2).alias("highest_rate"),
        F.round(ratio(F.sum(rate.cast("decimal(24,6)")), F.count(rate)) - F.lit(benchmark_rate), 2).alias("rate_gap"),
    )


SPREAD = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def rate_spread(rates: DataFrame, by: list[str], value: str = "actual_rate", width: float = 10.0) -> DataFrame:
    """Per group: how many rates, the lowest and highest, and exact (lower) quantiles. Null rates and groups are left out.

    Equal rates are merged and only the bins of `width` that hold a quantile are ordered, so that a group with most of
    the rows is not sorted in one task.
    """
    ends = rates.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        n_rows().alias("rates"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return ends.join(exact_quantiles(rates, by, value, SPREAD, width), by)


def late_flags(assessments: DataFrame, gaps: DataFrame, within_hours: int = 24) -> DataFrame:
    """Under-coding flags per assessment with whether they came in time; batch twin of the streaming job."""
    flagged = assessments.join(gaps.filter("undercoded").select("patient_id", "daily_gap"), "patient_id")
    due = F.col("assessed_at") + F.make_dt_interval(F.lit(0), F.lit(within_hours))
    return flagged.withColumn("late", F.col("seen_at") > due)
