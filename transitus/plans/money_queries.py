"""Denials and reimbursement. Rates, maps and lists here are invented; real ones are inputs."""

from datetime import date

from pyspark.sql import functions as F

from transitus.functions.columns import lookup, n_rows
from transitus.operators import denial, reimbursement as rb
from transitus.plans.registry import query
from transitus.sources.binding import FOCUS, add_days

STATUS = """CASE WHEN outstanding > 0 AND date_diff('day', service_at, billed_at) > 60 THEN 'LIKELY_DENIED'
                 WHEN outstanding > 0 THEN 'PENDING' ELSE 'PAID' END"""
LINES = f"lines AS (SELECT c.*, e.payer, e.encounter_class, date_diff('day', service_at, billed_at)::BIGINT AS days_to_payment, {STATUS} AS payment_status FROM clm c JOIN encpay e USING (encounter_id))"


def lines(t):
    return denial.infer_payment_status(t.claims, t.encounter_payers, t.payers)


@query("infer_payment_status", "clm encpay", f"""WITH {LINES}
    SELECT encounter_id, line, payer, outstanding::DOUBLE AS outstanding, days_to_payment, payment_status FROM lines WHERE encounter_class = 'snf'""")
def infer_payment_status(t):
    return denial.infer_payment_status(t.claims, t.encounter_payers, t.payers, FOCUS).select(
        "encounter_id", "line", "payer", F.col("outstanding").cast("double").alias("outstanding"), "days_to_payment", "payment_status"
    )


@query("denial_rate_by_payer", "clm encpay", f"""WITH {LINES}
    SELECT payer, count(*)::BIGINT AS lines, count_if(payment_status = 'LIKELY_DENIED')::BIGINT AS denied,
           count_if(payment_status = 'LIKELY_DENIED')::DOUBLE * 100.0 / count(*)::DOUBLE AS denial_rate_pct FROM lines GROUP BY 1""")
def denial_rate_by_payer(t):
    return denial.denial_rate_by_payer(lines(t))


RISK = f"""per AS (SELECT c.encounter_id, c.diagnosis, e.payer, count(*) AS n, count_if({STATUS} = 'LIKELY_DENIED') AS d, sum(charge) AS ch, sum(outstanding) AS un
       FROM clmdx c JOIN encpay e USING (encounter_id) GROUP BY ALL),
  risk AS (SELECT payer, diagnosis, count(*)::BIGINT AS total_encounters, count_if(d > 0)::DOUBLE * 100.0 / count(*)::DOUBLE AS denial_rate_pct,
       sum(ch)::DOUBLE AS total_charged, sum(un)::DOUBLE AS total_outstanding, sum(d)::DOUBLE * 100.0 / sum(n)::DOUBLE AS pct_lines_denied FROM per GROUP BY ALL)"""


def risk(t):
    return denial.denial_risk(t.claim_diagnoses, t.encounter_payers, ["payer", "diagnosis"])


@query("denial_risk", "clmdx encpay", f"WITH {RISK} SELECT * FROM risk")
def denial_risk(t):
    return risk(t)


@query("revenue_at_risk", "clmdx encpay", f"""WITH {RISK}
    SELECT payer, diagnosis, total_encounters, round(denial_rate_pct * total_charged / 10000.0::DOUBLE, 0) AS estimated_denials,
           round(denial_rate_pct * total_charged / 100.0::DOUBLE, 0) AS denied_dollars, pct_lines_denied, round(total_outstanding, 0) AS current_outstanding
    FROM risk WHERE payer <> 'NO_INSURANCE'""")
def revenue_at_risk(t):
    return denial.revenue_at_risk(risk(t))


@query("denial_by_day_of_stay", "clm encpay", f"""WITH {LINES}
    SELECT l.payer, CASE WHEN d < 0 THEN -1 WHEN d < 7 THEN 0 WHEN d < 14 THEN 7 WHEN d < 60 THEN 14 ELSE 60 END::BIGINT AS from_day, count(*)::BIGINT AS lines,
           count_if(payment_status = 'LIKELY_DENIED')::BIGINT AS denied, count_if(payment_status = 'LIKELY_DENIED')::DOUBLE * 100.0 / count(*)::DOUBLE AS denial_rate_pct
    FROM (SELECT l.*, date_diff('day', e.start_at, l.billed_at) AS d FROM lines l JOIN encpay e USING (encounter_id)) l GROUP BY ALL""")
def denial_by_day_of_stay(t):
    return denial.denial_by_day_of_stay(lines(t), t.encounters, "billed_at", [0, 7, 14, 60])


RULES = [("AUTOMOBILE", 0, 1200, "submit continued stay review"), ("BUILDING", 0, 900, "peer review"),
         ("MACHINERY", 500, 2000, "send therapy notes"), ("MACHINERY", 1500, 2400, "final appeal")]
AS_OF = date(2001, 8, 2)
ALERTS = """al AS (SELECT e.encounter_id, e.patient_id, payer, date_diff('day', start_at, DATE '2001-08-02')::BIGINT AS day_of_stay, alert, b FROM encpay e
       JOIN (VALUES ('AUTOMOBILE', 0, 1200, 'submit continued stay review'), ('BUILDING', 0, 900, 'peer review'),
                    ('MACHINERY', 500, 2000, 'send therapy notes'), ('MACHINERY', 1500, 2400, 'final appeal')) r(payer, a, b, alert) USING (payer)
       WHERE stop_at IS NULL AND date_diff('day', start_at, DATE '2001-08-02') BETWEEN a AND b)"""


@query("active_denial_alerts", "encpay", f"WITH {ALERTS} SELECT encounter_id, patient_id, payer, day_of_stay, alert, (b - day_of_stay)::BIGINT AS days_left FROM al")
def active_denial_alerts(t):
    return denial.active_denial_alerts(t.encounter_payers, RULES, AS_OF)


CATEGORY = "(SELECT patient_id, arg_min(category, (start_at, code)) AS clinical_category FROM cond JOIN (SELECT code, category FROM cat) USING (code) GROUP BY 1)"


@query("denial_letter_prompts", "encpay pat cond cat", f"""WITH {ALERTS}
    SELECT encounter_id, sha256('Write a continued stay review of about 200 words that justifies the stay to the payer.' || chr(10) || 'Patient: ' || patient_name ||
      ' (' || al.payer || '). Day of stay: ' || day_of_stay || '. Diagnosis: ' || coalesce(clinical_category, 'Not documented') || '. Situation: ' || alert || '.') AS prompt_hash
    FROM al JOIN pat USING (patient_id) LEFT JOIN {CATEGORY} USING (patient_id)""")
def denial_letter_prompts(t):
    alerts = denial.active_denial_alerts(t.encounter_payers, RULES, AS_OF)
    diagnosis = rb.clinical_category(t.conditions, t.catalogue).withColumnRenamed("clinical_category", "diagnosis")
    return denial.denial_letter_prompts(alerts, t.patients, diagnosis).select(
        "encounter_id", F.sha2("prompt", 256).alias("prompt_hash")
    )


@query("referral_scorecard", "clm encpay", f"""WITH {LINES},
    per AS (SELECT encounter_id, payer, count_if(payment_status = 'LIKELY_DENIED') AS d, sum(outstanding) AS un FROM lines GROUP BY ALL),
    r AS (SELECT payer, count_if(d > 0)::DOUBLE * 100.0 / count(*)::DOUBLE AS denial_rate_pct, sum(un)::DOUBLE AS total_outstanding FROM per GROUP BY 1),
    s AS (SELECT payer, count(*)::BIGINT AS stays, sum(total_cost)::DOUBLE / count(*)::DOUBLE AS avg_stay_cost,
                 sum(date_diff('day', start_at, stop_at))::DOUBLE / count(stop_at)::DOUBLE AS avg_los_days FROM encpay WHERE encounter_class = 'snf' GROUP BY 1)
    SELECT payer, stays, denial_rate_pct, avg_stay_cost, avg_los_days, total_outstanding, avg_stay_cost * (1.0::DOUBLE - denial_rate_pct / 100.0::DOUBLE) AS expected_revenue,
           CASE WHEN denial_rate_pct < 20 THEN 'ACCEPT' WHEN denial_rate_pct < 50 THEN 'REVIEW' ELSE 'CAUTION' END AS grade FROM r JOIN s USING (payer)""")
def referral_scorecard(t):
    return denial.referral_scorecard(denial.denial_risk(t.claims, t.encounter_payers, ["payer"]), t.encounter_payers, FOCUS)


@query("state_benchmarks", "fac", """
    SELECT chain AS state, count(*)::BIGINT AS facilities, round(sum(1 + organization_id % 5)::DOUBLE / count(*)::DOUBLE, 1) AS avg_stars,
           round(sum(organization_id % 7)::DOUBLE / count(*)::DOUBLE, 2) AS avg_denials, sum(organization_id % 7)::BIGINT AS total_denials
    FROM fac GROUP BY 1 ORDER BY total_denials DESC, state LIMIT 20""")
def state_benchmarks(t):
    k = F.col("organization_id")
    return denial.state_benchmarks(t.facilities.select(
        F.col("chain").alias("state"), (k % 5 + 1).alias("overall_rating"), (k % 7).alias("payment_denials")))


@query("appeal_success", "clmdx encpay", """
    SELECT payer, diagnosis, count(*)::BIGINT AS denials, count_if(outstanding <= 0)::BIGINT AS overturned,
           count_if(outstanding <= 0)::DOUBLE * 100.0 / count(*)::DOUBLE AS overturn_rate_pct
    FROM clmdx JOIN encpay USING (encounter_id) WHERE date_diff('day', service_at, billed_at) > 60 GROUP BY ALL""")
def appeal_success(t):
    return denial.appeal_success(
        denial.infer_payment_status(t.claim_diagnoses, t.encounter_payers, t.payers), ["payer", "diagnosis"]
    )


@query("facility_benchmark", "trans fac", """
    WITH s AS (SELECT organization_id, facility, chain, count(*)::BIGINT AS stays, sum(length_of_stay)::DOUBLE AS d, count(length_of_stay)::DOUBLE AS c,
                      count_if(readmitted)::DOUBLE AS h FROM trans JOIN fac USING (organization_id) GROUP BY ALL),
    m AS (SELECT chain, sum(d) / sum(c) AS l, sum(h) * 100.0 / sum(stays)::DOUBLE AS r FROM s GROUP BY 1)
    SELECT organization_id, facility, chain, stays, d / c AS avg_los, h * 100.0 / stays::DOUBLE AS readmission_pct, d / c - l AS los_delta,
           h * 100.0 / stays::DOUBLE - r AS readmission_delta FROM s JOIN m USING (chain)""")
def facility_benchmark(t):
    return denial.facility_benchmark(t.transitions, t.facilities)


@query("clinical_category", "cond cat", f"SELECT * FROM {CATEGORY}")
def clinical_category(t):
    return rb.clinical_category(t.conditions, t.catalogue)


def qualifying(t):
    return t.catalogue.filter("size >= 25")


COMORB = "(SELECT patient_id, count(DISTINCT code)::BIGINT AS n_comorbidities, least(count(DISTINCT code), 2)::BIGINT AS comorbidity_class FROM cond WHERE code IN (SELECT code FROM cat WHERE size >= 25) GROUP BY 1)"


@query("comorbidity_count", "cond cat", f"SELECT * FROM {COMORB}")
def comorbidity_count(t):
    return rb.comorbidity_count(t.conditions, qualifying(t))


SERVICES = ["IV", "ventilator", "dialysis", "chemo", "radiation", "wound care", "transfusion"]


def service_map(t):
    name = F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.col("size") % 7 + 1).cast("int"))
    return t.catalogue.filter("size >= 40").select("code", name.alias("service"))


SVC = ("svc AS (SELECT patient_id, CASE size % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SERVICES)) +
       " END AS service, count(*)::BIGINT AS n FROM (SELECT patient_id, code FROM proc UNION ALL SELECT patient_id, code FROM med) JOIN cat USING (code) WHERE size >= 40 GROUP BY ALL)")


def services(t):
    return rb.nta_services(t.procedures, t.medications, service_map(t))


@query("nta_services", "proc med cat", f"WITH {SVC} SELECT * FROM svc")
def nta_services(t):
    return services(t)


NURSING = [(c, n, "ABCDE"[min(4, i % 3 + n)]) for i, c in enumerate(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) for n in (0, 1, 2)]
RATES = ([("NURSING", c, 90.0 + 35.5 * i) for i, c in enumerate("ABCDE")] + [("NTA", c, 20.0 + 18.25 * i) for i, c in enumerate("ABCDEF")]
         + [(t, c, 40.0 + 12.4 * i + j) for j, t in enumerate(rb.THERAPIES) for i, c in enumerate("ABCD")])
BASE = 95.5


def classes(t):
    return rb.component_classes(
        t.patients, rb.clinical_category(t.conditions, t.catalogue), rb.comorbidity_count(t.conditions, qualifying(t)),
        services(t), NURSING, F.col("patient_id") % 25,
    )


NURSE = "CASE (coalesce(clinical_category, '') || '|' || coalesce(comorbidity_class, 0)) " + " ".join(f"WHEN '{c}|{n}' THEN '{k}'" for c, n, k in NURSING) + " ELSE 'A' END"
CLS = f"""{SVC}, cls AS (SELECT p.patient_id, clinical_category, coalesce(comorbidity_class, 0)::BIGINT AS comorbidity_class, coalesce(k, 0)::BIGINT AS n_services,
    {NURSE} AS nursing_class, substr('ABCDEF', least(coalesce(k, 0), 5)::INT + 1, 1) AS nta_class, substr('ABCD', least((p.patient_id % 25) // 6, 3)::INT + 1, 1) AS therapy_class
    FROM pat p LEFT JOIN {CATEGORY} USING (patient_id) LEFT JOIN {COMORB} USING (patient_id)
    LEFT JOIN (SELECT patient_id, count(*) AS k FROM svc GROUP BY 1) USING (patient_id))"""
RATE = "rate(component, class, rate) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c:.2f}::DECIMAL(18,2))" for a, b, c in RATES) + ")"
OPT = f"""{CLS}, {RATE}, opt AS (SELECT patient_id, (sum(rate) + 95.50::DECIMAL(18,2))::DOUBLE AS optimal_rate FROM cls JOIN rate
    ON (component = 'NURSING' AND class = nursing_class) OR (component = 'NTA' AND class = nta_class) OR (component IN ('PT', 'OT', 'SLP') AND class = therapy_class) GROUP BY 1),
  act AS (SELECT patient_id, sum(date_diff('day', start_at, stop_at))::BIGINT AS n_days, sum(total_cost)::DOUBLE AS cost,
                 sum(total_cost)::DOUBLE / nullif(sum(date_diff('day', start_at, stop_at)), 0)::DOUBLE AS actual_rate FROM enc WHERE stop_at IS NOT NULL GROUP BY 1),
  gap AS (SELECT *, optimal_rate - actual_rate / 100 AS daily_gap FROM opt JOIN act USING (patient_id))"""


@query("component_classes", "pat proc med cond cat", f"WITH {CLS} SELECT * FROM cls")
def component_classes(t):
    return classes(t)


@query("optimal_daily_rate", "pat proc med cond cat enc", f"WITH {OPT} SELECT patient_id, optimal_rate FROM opt")
def optimal_daily_rate(t):
    return rb.optimal_daily_rate(classes(t), RATES, BASE)


def gaps(t):
    """Order prices are about a hundred times a daily rate; the actual rate is scaled to match."""
    actual = rb.actual_daily_rate(t.encounters).withColumn("actual_rate", F.col("actual_rate") / 100)
    return rb.undercoded(rb.optimal_daily_rate(classes(t), RATES, BASE), actual)


@query("undercoded", "pat proc med cond cat enc", f"""WITH {OPT}
    SELECT patient_id, optimal_rate, n_days, actual_rate / 100 AS actual_rate, daily_gap, coalesce(daily_gap > 100, FALSE) AS undercoded FROM gap""")
def undercoded(t):
    return gaps(t).drop("cost")


MISSED = """missed AS (SELECT DISTINCT patient_id, code, EXISTS (SELECT 1 FROM mds m WHERE m.patient_id = c.patient_id AND left(m.code, 3) = left(c.code, 3)) AS refines
    FROM cond c WHERE NOT EXISTS (SELECT 1 FROM mds m WHERE m.patient_id = c.patient_id AND m.code = c.code))"""


@query("missed_codes", "cond mds", f"WITH {MISSED} SELECT * FROM missed")
def missed_codes(t):
    return rb.missed_codes(t.conditions, t.assessed_codes)


CODES = """found AS (SELECT DISTINCT patient_id, unnest(regexp_extract_all(text, '\\b([A-TV-Z][0-9][0-9A-Z](?:\\.[0-9A-Z]{1,4})?)\\b', 1)) AS code FROM note)"""


@query("extract_codes", "note cat", f"WITH {CODES} SELECT patient_id, code FROM found WHERE code IN (SELECT code FROM cat)")
def extract_codes(t):
    return rb.extract_codes(t.notes, t.catalogue, ["patient_id"])


def synonyms(t):
    """One code per phrase: the smallest one of the catalogue, for two words or the group name."""
    two = t.catalogue.groupBy(F.lower("description").alias("phrase")).agg(F.min("code").alias("code"))
    return two.unionAll(t.catalogue.groupBy(F.lower("category").alias("phrase")).agg(F.min("code").alias("code")))


SYN = "syn AS (SELECT lower(description) AS phrase, min(code) AS code FROM cat GROUP BY 1 UNION ALL SELECT lower(category), min(code) FROM cat GROUP BY 1)"
TERM = f"""{SYN}, sent AS (SELECT DISTINCT patient_id, trim(translate(unnest(regexp_split_to_array(regexp_replace(text, '(\\d)\\.(\\d)', '\\1~\\2', 'g'), '[.!?\\n]+')), '~', '.')) AS sentence FROM note),
  said AS (SELECT * FROM sent WHERE sentence <> '' AND NOT regexp_matches(sentence, '(?i)(^|[^\\p{{L}}])(denies|denied|no|not|without|negative for|family history)($|[^\\p{{L}}])')),
  term AS (SELECT patient_id, code, phrase, sentence FROM said JOIN syn ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')
           UNION SELECT patient_id, 'E66.9', 'obesity', sentence FROM said WHERE try_cast(nullif(regexp_extract(sentence, '(?i)\\bBMI\\s+([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) >= 30)"""


def terms(t):
    return rb.note_terms(t.notes, synonyms(t), 2, ["patient_id"])


@query("extract_terms", "note cat", f"WITH {TERM} SELECT * FROM term")
def extract_terms(t):
    return terms(t)


def impact(t):
    """Component and invented daily value of each code."""
    own = t.catalogue.select(
        "code", F.when(F.col("size") % 2 == 0, "NURSING").otherwise("NTA").alias("component"),
        (F.col("size") * F.lit(2.5).cast("decimal(4,2)")).cast("decimal(18,2)").alias("daily_value"))
    extra = [F.lit("E66.9"), F.lit("NURSING"), F.lit(50).cast("decimal(18,2)")]
    return own.unionAll(t.spark.range(1).select(*extra))


IMP = """imp AS (SELECT code, CASE WHEN size % 2 = 0 THEN 'NURSING' ELSE 'NTA' END AS component, (size * 2.5::DECIMAL(4,2))::DECIMAL(18,2) AS daily_value FROM cat
  UNION ALL SELECT 'E66.9', 'NURSING', 50)"""
GAPS = f"""{TERM}, {IMP}, ng AS (SELECT patient_id, code, min(sentence) AS evidence, count(*)::BIGINT AS mentions, component, daily_value FROM term LEFT JOIN imp USING (code)
    WHERE NOT EXISTS (SELECT 1 FROM mds m WHERE m.patient_id = term.patient_id AND m.code = term.code) GROUP BY ALL)"""


def note_gaps_of(t):
    return rb.note_gaps(terms(t), t.assessed_codes, impact(t))


@query("note_gaps", "note cat mds", f"WITH {GAPS} SELECT patient_id, code, evidence, mentions, component, daily_value::DOUBLE AS daily_value FROM ng")
def note_gaps(t):
    return note_gaps_of(t).withColumn("daily_value", F.col("daily_value").cast("double"))


@query("discharge_gap", "note cat mds", f"""WITH {CODES}, {IMP},
    g AS (SELECT patient_id, component, max(daily_value) AS best, count(*) AS n FROM found f LEFT JOIN imp USING (code)
          WHERE NOT EXISTS (SELECT 1 FROM mds m WHERE m.patient_id = f.patient_id AND m.code = f.code) GROUP BY ALL)
    SELECT patient_id, sum(n)::BIGINT AS missed, sum(best)::DOUBLE AS daily_gap, sum(best * 21)::DOUBLE AS projected_recovery FROM g GROUP BY 1""")
def discharge_gap(t):
    found = rb.extract_codes(t.notes, t.catalogue, ["patient_id"])
    return rb.discharge_gap(found, t.assessed_codes, impact(t))


@query("revenue_impact", "pat proc med cond cat enc fac", f"""WITH {OPT},
    g AS (SELECT patient_id % 10 AS organization_id, chain, daily_gap::DECIMAL(24,6) AS d FROM gap JOIN fac ON fac.organization_id = patient_id % 10)
    SELECT chain, organization_id, grouping(chain, organization_id)::BIGINT AS level, count(*)::BIGINT AS patients, sum(d)::DOUBLE AS daily_gap
    FROM g GROUP BY ROLLUP (chain, organization_id)""")
def revenue_impact(t):
    own = gaps(t).select((F.col("patient_id") % 10).alias("organization_id"), F.col("daily_gap").cast("decimal(24,6)").alias("daily_gap"))
    return rb.revenue_impact(own, t.facilities)


@query("scenario", "enc", """
    SELECT organization_id, scenario, count(*) * share AS undercoded, count(*) * share * gap AS yearly_value
    FROM enc, (VALUES ('one comorbidity', 0.3::DOUBLE, 1500.0::DOUBLE), ('one service', 0.3, 2000.0), ('full', 0.5, 2500.0)) s(scenario, share, gap)
    GROUP BY organization_id, scenario, share, gap""")
def scenario(t):
    return rb.scenario(
        t.encounters.groupBy("organization_id").agg(n_rows().alias("admissions")),
        [("one comorbidity", 0.3, 1500.0), ("one service", 0.3, 2000.0), ("full", 0.5, 2500.0)],
    )


REC = f"""{GAPS}, rec AS (SELECT patient_id AS recommendation_id, count(DISTINCT code)::BIGINT AS n_codes, sum(daily_value) AS g, min(evidence) AS evidence,
      string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ng GROUP BY 1),
  ev AS (SELECT transition_id AS recommendation_id, CASE action WHEN 'APPROVED' THEN 'ACCEPTED' WHEN 'REJECTED' THEN 'DISMISSED' ELSE action END AS action, actor, action_at + (transition_id % 3)::INT * INTERVAL 31 DAY AS action_at, log_id FROM evt),
  fst AS (SELECT recommendation_id, arg_min(action, (action_at, log_id)) AS status, arg_min(actor, (action_at, log_id)) AS reviewed_by, min(action_at) AS reviewed_at
          FROM ev WHERE action IN ('ACCEPTED', 'DISMISSED') GROUP BY 1)"""


def recommendation_events(t):
    """The review log covers one month; a recommendation is reviewed in that one or in one of the next two."""
    later = (F.col("transition_id") % 3 * 31).cast("int")
    renamed = lookup(F.col("action"), {"APPROVED": "ACCEPTED", "REJECTED": "DISMISSED"})
    return t.review_events.select(
        F.col("transition_id").alias("recommendation_id"), add_days("action_at", later).alias("at"), F.col("log_id").alias("id"),
        F.coalesce(renamed, F.col("action")).alias("action"), "actor", F.col("actor_role").alias("role"),
    )


@query("coding_recommendations", "note cat mds evt", f"""WITH {REC}
    SELECT recommendation_id, n_codes, codes, g::DOUBLE AS daily_revenue_gap, (g * 21)::DOUBLE AS total_revenue_opportunity, evidence,
           coalesce(status, 'PENDING') AS status, reviewed_by, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at
    FROM rec LEFT JOIN fst USING (recommendation_id)""")
def coding_recommendations(t):
    made = rb.coding_recommendations(note_gaps_of(t), "V2")
    return made.join(rb.recommendation_state(recommendation_events(t)), "recommendation_id", "left").select(
        "recommendation_id", "n_codes", F.array_join("recommended_additions", ",").alias("codes"), "daily_revenue_gap",
        "total_revenue_opportunity", "evidence", F.coalesce("status", F.lit("PENDING")).alias("status"), "reviewed_by",
        F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss").alias("reviewed_at"),
    )


@query("recovery_trend", "note cat mds evt", f"""WITH {REC}, m AS (SELECT strftime(reviewed_at, '%Y-%m') AS month, count(*)::BIGINT AS accepted, sum(g * 21) AS v
      FROM rec JOIN fst USING (recommendation_id) WHERE status = 'ACCEPTED' GROUP BY 1)
    SELECT month, accepted, v::DOUBLE AS recovered, (v - lag(v) OVER (ORDER BY month))::DOUBLE AS change FROM m""")
def recovery_trend(t):
    made = rb.coding_recommendations(note_gaps_of(t), "V2")
    return rb.recovery_trend(made, rb.recommendation_state(recommendation_events(t)))


@query("coding_profile", "pat proc med cond cat enc mds", f"""WITH {OPT},
    r AS (SELECT patient_id, actual_rate / 100 AS a, k, patient_id IN (SELECT patient_id FROM svc) AS s FROM gap LEFT JOIN (SELECT patient_id, count(DISTINCT code) AS k FROM mds GROUP BY 1) USING (patient_id))
    SELECT count(*)::BIGINT AS patients, count_if(coalesce(k >= 3, FALSE))::DOUBLE * 100.0 / count(*)::DOUBLE AS pct_three_or_more, count_if(s)::DOUBLE * 100.0 / count(*)::DOUBLE AS pct_with_service,
           round(min(a), 2) AS lowest_rate, round(max(a), 2) AS highest_rate, round(sum(a::DECIMAL(24,6))::DOUBLE / count(a)::DOUBLE - 785::DOUBLE, 2) AS rate_gap FROM r""")
def coding_profile(t):
    return rb.coding_profile(t.assessed_codes, gaps(t), services(t), 785.0)


@query("rate_spread", "pat enc", """
    WITH r AS (SELECT patient_id, sum(total_cost)::DOUBLE / nullif(sum(date_diff('day', start_at, stop_at)), 0)::DOUBLE / 100 AS a FROM enc WHERE stop_at IS NOT NULL GROUP BY 1),
    o AS (SELECT payer, a, row_number() OVER (PARTITION BY payer ORDER BY a) AS i, count(*) OVER (PARTITION BY payer) AS n FROM r JOIN pat USING (patient_id) WHERE a IS NOT NULL)
    SELECT payer, count(*)::BIGINT AS rates, round(min(a), 4) AS lowest, round(max(a), 4) AS highest, round(min(CASE WHEN i * 10 >= n THEN a END), 4) AS p10,
           round(min(CASE WHEN i * 4 >= n THEN a END), 4) AS p25, round(min(CASE WHEN i * 2 >= n THEN a END), 4) AS p50,
           round(min(CASE WHEN i * 4 >= n * 3 THEN a END), 4) AS p75, round(min(CASE WHEN i * 10 >= n * 9 THEN a END), 4) AS p90 FROM o GROUP BY payer""")
def rate_spread(t):
    """Daily rates of patients by payer, scaled as in `gaps`."""
    paid = rb.actual_daily_rate(t.encounters).withColumn("actual_rate", F.col("actual_rate") / 100)
    out = rb.rate_spread(paid.join(t.patients.select("patient_id", "payer"), "patient_id"), ["payer"])
    return out.withColumns({c: F.round(c, 4) for c in ("lowest", "highest", *rb.SPREAD)})
