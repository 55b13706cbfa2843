"""Risk tiers, prompts, template documents, medication reconciliation and document checks."""

import re
from datetime import date

from pyspark.sql import functions as F

from transitus.functions.phrases import phrase_hits
from transitus.functions.text import words
from transitus.operators import cohort, guardrails, medrec, narrative
from transitus.plans.registry import query
from transitus.plans.tables import DOUBT, NEEDED, RISKY, TERMS

K = "transition_id"


def sql_list(table, name, extra=""):
    return (f"(SELECT transition_id, string_agg(description || ' (' || code || ')' || {extra or chr(39) * 2} || "
            f"CASE WHEN n > 1 THEN ' x' || n ELSE '' END, '; ' ORDER BY description, code, "
            f"{'reason, ' if extra else ''}start_at, stop_at) AS {name} FROM (SELECT transition_id, description, code, "
            f"{'reason, ' if extra else ''}start_at, stop_at, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY 1)")


VARIABLES = f"""
  vars AS (
    SELECT p.transition_id, c.patient_name, c.age::VARCHAR AS age, c.gender, p.from_setting, p.current_setting,
           strftime(p.admission_date, '%Y-%m-%d') AS admission_date, strftime(p.discharge_date, '%Y-%m-%d') AS discharge_date,
           p.readmitted::VARCHAR AS readmitted, p.n_conditions, p.n_medications, x.conditions, y.medications, z.allergies
    FROM prof p JOIN cohort c USING (patient_id)
    LEFT JOIN {sql_list('(SELECT t.transition_id, f.* FROM trans t JOIN cond f ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date))', 'conditions')} x USING (transition_id)
    LEFT JOIN {sql_list('(SELECT t.transition_id, f.* FROM trans t JOIN med f ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date))', 'medications', "' for ' || reason")} y USING (transition_id)
    LEFT JOIN {sql_list('(SELECT t.transition_id, f.* FROM trans t JOIN alg f ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date))', 'allergies')} z USING (transition_id))"""


def sql_fill(template, fallbacks, constants=None):
    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and piece in (constants or {}):
            out.append("'" + constants[piece] + "'")
        elif i % 2:
            out.append(f"coalesce({piece}::VARCHAR, '{fallbacks.get(piece, narrative.MISSING)}')")
        else:
            out.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


@query("risk_tier", "tier", "SELECT transition_id, patient_id, n_conditions, n_medications, readmitted, risk_tier FROM tier")
def risk_tier(t):
    return narrative.risk_tier(t.profile_counts).select(
        K, "patient_id", "n_conditions", "n_medications", "readmitted", "risk_tier"
    )


@query("render_prompts", "prof cohort cond med alg", "WITH " + VARIABLES + " " + " UNION ALL ".join(
    f"SELECT transition_id, '{s}' AS section, sha256({sql_fill(p, narrative.FALLBACKS[s])}) AS prompt_hash FROM vars"
    for s, p in narrative.PROMPTS.items()))
def render_prompts(t):
    return narrative.render_prompts(t.prompt_variables).select(
        K, "section", F.sha2("prompt", 256).alias("prompt_hash")
    )


@query("template_narrative", "prof cohort cond med alg", "WITH " + VARIABLES + """
    SELECT transition_id, """ + ", ".join(
    "sha256(" + sql_fill(p, narrative.FALLBACKS[s], {"as_of": "2024-06-30"}).replace(
        "coalesce(risk_tier::VARCHAR, 'Not documented')",
        "CASE WHEN n_conditions >= 8 OR n_medications >= 10 OR readmitted = 'true' THEN 'HIGH' "
        "WHEN n_conditions >= 4 OR n_medications >= 5 THEN 'MEDIUM' ELSE 'LOW' END") + f") AS {s}_hash"
    for s, p in narrative.DOCUMENTS.items()) + " FROM vars")
def template_narrative(t):
    docs = narrative.template_narrative(t.prompt_variables, "2024-06-30")
    return docs.select(K, *[F.sha2(s, 256).alias(f"{s}_hash") for s in narrative.DOCUMENTS])


def word_counter():
    return lambda texts: [f"{len(x.split())} words" for x in texts]


@query("batch_generate", "nar", """
    SELECT transition_id, len(list_filter(regexp_split_to_array(clinical_handoff, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words
    FROM nar""")
def batch_generate(t):
    prompts = t.narratives.select(K, F.lit("clinical_handoff").alias("section"), F.col("clinical_handoff").alias("prompt"))
    outputs = narrative.batch_generate(prompts, word_counter, "word-counter")
    done = narrative.attach_outputs(prompts, outputs, None)
    return done.select(K, F.split("output", " ")[0].cast("bigint").alias("n_words"))


@query("narrative_preview", "nar", """
    SELECT transition_id, risk_tier, strftime(generated_at, '%Y-%m-%d %H') AS generated_at,
           left(clinical_handoff, 200) AS clinical_handoff_preview
    FROM nar ORDER BY nar.generated_at DESC, transition_id DESC LIMIT 10""")
def narrative_preview(t):
    return narrative.narrative_preview(t.narratives, ["clinical_handoff"]).withColumn(
        "generated_at", F.date_format("generated_at", "yyyy-MM-dd HH")
    )


@query("first_narrative", "nar", """
    SELECT transition_id, risk_tier, clinical_handoff FROM nar
    WHERE transition_id = (SELECT min(transition_id) FROM nar)""")
def first_narrative(t):
    return narrative.first_narrative(t.narratives).select(K, "risk_tier", "clinical_handoff")


@query("care_brief", "trans", """
    SELECT transition_id, patient_id, h.horizon, strftime(discharge_date::DATE + h.d, '%Y-%m-%d') AS due_date
    FROM trans, (VALUES ('within 24 hours', 1), ('within 7 days', 7), ('within 30 days', 30)) h(horizon, d)""")
def care_brief(t):
    return narrative.care_brief(t.transitions).withColumn("due_date", F.date_format("due_date", "yyyy-MM-dd"))


PAIRS = [("ring+rod", "Brand#1", "Brand#2", "HIGH"), ("gear+bolt", "Brand#3", "Brand#4", "MODERATE")]
ALERT = ["Brand#5", "Brand#6", "Brand#7"]
INDICATIONS = [("ECONOMY", "Brand#1"), ("ECONOMY", "Brand#8"), ("PROMO", "Brand#2"), ("SMALL", "Brand#9")]
CLS = "(SELECT DISTINCT a.transition_id, a.code, a.description, cat.drug_class FROM actmed a JOIN cat USING (code))"


@query("drug_interactions", "actmed cat", f"""
    WITH m AS {CLS}, r(rule, class_a, class_b, severity) AS (VALUES
      ('ring+rod', 'Brand#1', 'Brand#2', 'HIGH'), ('gear+bolt', 'Brand#3', 'Brand#4', 'MODERATE')),
    p AS (SELECT a.transition_id, r.rule, r.severity, a.code AS ca, a.description AS da, b.code AS cb, b.description AS db
          FROM m a JOIN r ON a.drug_class = r.class_a JOIN m b ON b.transition_id = a.transition_id AND b.drug_class = r.class_b)
    SELECT DISTINCT transition_id, rule, severity, 'A' AS side, ca AS code, da AS description FROM p
    UNION ALL SELECT DISTINCT transition_id, rule, severity, 'B', cb, db FROM p""")
def drug_interactions(t):
    return medrec.drug_interactions(t.held_medications, t.drug_classes, K, PAIRS)


@query("allergy_conflicts", "actmed actalg cat", f"""
    WITH m AS {CLS}
    SELECT m.transition_id, m.code, m.description, m.drug_class, count(*)::BIGINT AS n_allergies, max(a.severity) AS worst_severity
    FROM m JOIN actalg a ON a.transition_id = m.transition_id JOIN cat c ON c.code = a.code AND c.drug_class = m.drug_class
    GROUP BY ALL""")
def allergy_conflicts(t):
    held = cohort.active_facts(t.transitions, t.allergies)
    return medrec.allergy_conflicts(t.held_medications, held, t.drug_classes, K)


@query("therapy_gaps", "actmed actcond cat", f"""
    WITH m AS {CLS}, i(category, drug_class) AS (VALUES ('ECONOMY', 'Brand#1'), ('ECONOMY', 'Brand#8'), ('PROMO', 'Brand#2'), ('SMALL', 'Brand#9')),
    c AS (SELECT DISTINCT a.transition_id, a.code, a.description, cat.category FROM actcond a JOIN cat USING (code)
          WHERE cat.category IN (SELECT category FROM i))
    SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i JOIN m ON m.drug_class = i.drug_class
                                      WHERE i.category = c.category AND m.transition_id = c.transition_id)""")
def therapy_gaps(t):
    return medrec.therapy_gaps(t.held_conditions, t.held_medications, t.drug_classes, t.catalogue, INDICATIONS, K)


@query("duplicate_therapy", "actmed cat", f"""
    WITH m AS {CLS} SELECT transition_id, drug_class, count(*)::BIGINT AS n_drugs FROM m GROUP BY ALL HAVING count(*) > 1""")
def duplicate_therapy(t):
    return medrec.duplicate_therapy(t.held_medications, t.drug_classes, K)


@query("high_alert_meds", "actmed cat", f"""
    WITH m AS {CLS} SELECT * FROM m WHERE drug_class IN ('Brand#5', 'Brand#6', 'Brand#7')""")
def high_alert_meds(t):
    return medrec.high_alert_meds(t.held_medications, t.drug_classes, K, ALERT)


@query("meds_by_condition", "actmed actcond", """
    SELECT m.transition_id, m.reason, count(DISTINCT m.code)::BIGINT AS n_drugs,
           EXISTS (SELECT 1 FROM actcond c WHERE c.transition_id = m.transition_id AND c.description = m.reason) AS listed
    FROM actmed m GROUP BY m.transition_id, m.reason""")
def meds_by_condition(t):
    return medrec.meds_by_condition(t.held_medications, t.held_conditions, K)


@query("med_changes", "trans med", """
    SELECT t.transition_id, count_if(m.start_at >= t.admission_date)::BIGINT AS started,
           count_if(coalesce(m.stop_at <= t.discharge_date, FALSE))::BIGINT AS stopped,
           count_if(m.start_at < t.admission_date AND (m.stop_at IS NULL OR m.stop_at > t.discharge_date))::BIGINT AS unchanged
    FROM trans t JOIN med m ON m.patient_id = t.patient_id AND m.start_at <= t.discharge_date
     AND (m.stop_at IS NULL OR m.stop_at >= t.admission_date) GROUP BY 1""")
def med_changes(t):
    return medrec.med_changes(t.held_medications, t.transitions)


@query("validate_profiles", "prof", """
    SELECT transition_id, patient_id,
           n_conditions > 0 AND NOT coalesce(date_diff('day', discharge_date, DATE '2001-07-20') > 30, FALSE) AS is_valid,
           concat_ws(',', CASE WHEN n_medications = 0 THEN 'NO_MEDICATIONS' END,
                          CASE WHEN n_allergies = 0 THEN 'NO_ALLERGIES_DOCUMENTED' END,
                          CASE WHEN date_diff('day', discharge_date, DATE '2001-07-20') > 14 THEN 'STALE_DATA' END,
                          CASE WHEN discharge_date IS NULL THEN 'OPEN_STAY' END) AS warnings
    FROM prof""")
def validate_profiles(t):
    checked = guardrails.validate_profiles(
        t.profile_counts, cohort.cohort_ids(t.encounters, "snf"), date(2001, 7, 20)
    )
    return checked.withColumn("warnings", F.array_join("warnings", ","))


WORDS = "list_filter(regexp_split_to_array(lower(clinical_handoff), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
HALL = f"""
  tok AS (SELECT transition_id, {WORDS} AS w FROM nar),
  gram AS (SELECT transition_id, unnest(w) AS term FROM tok
    UNION ALL SELECT transition_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM tok
    UNION ALL SELECT transition_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM tok),
  wrong AS (SELECT DISTINCT g.transition_id, g.term FROM gram g JOIN documents d ON d.doc_id = g.transition_id
    WHERE g.term IN ('the', 'der', 'les', 'los', 'of the', 'the of and')
      AND g.term <> CASE d.lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'der' WHEN 'fr' THEN 'les' ELSE 'los' END)"""


@query("term_hallucination", "nar", f"WITH {HALL} SELECT transition_id, term FROM wrong")
def term_hallucination(t):
    return guardrails.term_hallucination(t.narratives, t.listed_terms, TERMS, "clinical_handoff")


def pairs_sql(table, key, text):
    """Neighbouring words of a text, as SQL."""
    split = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return (f"(SELECT {key}, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS phrase "
            f"FROM (SELECT {key}, {split} AS w FROM {table}))")


@query("dictionary_mentions", "", f"""
    WITH dict AS (SELECT DISTINCT phrase FROM {pairs_sql('conversations', 'conv_id', 'text')}),
    hits AS (SELECT doc_id, phrase FROM {pairs_sql('documents', 'doc_id', 'text')} WHERE phrase IN (SELECT phrase FROM dict))
    SELECT doc_id, count(*)::BIGINT AS places, count(DISTINCT phrase)::BIGINT AS phrases FROM hits GROUP BY 1""")
def dictionary_mentions(t):
    """A dictionary of some ten thousand phrases up: every pair of neighbouring words in the conversations."""
    told = t.table("conversations").select(words("text").alias("_w")).filter(F.size("_w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda at: F.array_join(F.slice("_w", at, F.lit(2)), " "))
    dictionary = told.select(F.explode(pairs).alias("phrase")).distinct()
    hits = phrase_hits(t.documents.select("doc_id", words("text").alias("_w")), ["doc_id"], "_w", dictionary, "phrase")
    return hits.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("places"), F.count_distinct("phrase").cast("bigint").alias("phrases")
    )


UNSURE = r"(?i)(^|[^\p{L}\p{N}])(not sure|might|that it|que la)($|[^\p{L}\p{N}])"
NWORDS = "len(list_filter(regexp_split_to_array(clinical_handoff, '\\s+'), lambda x: x <> ''))"
RISKY_SQL = ("clinical_handoff ILIKE '%stop taking%' OR clinical_handoff ILIKE '%discontinue%immediately%' OR "
             "clinical_handoff ILIKE '%increase%dose%' OR clinical_handoff ILIKE '%from%of the%'")
FULL_SQL = "clinical_handoff ILIKE '%the%' AND clinical_handoff ILIKE '%and%'"


@query("text_checks", "nar", f"""
    SELECT transition_id, CASE WHEN {RISKY_SQL} THEN 'DANGEROUS_LANGUAGE' ELSE 'PASS' END AS safety,
           CASE WHEN {FULL_SQL} THEN 'PASS' ELSE 'INCOMPLETE' END AS complete,
           CASE WHEN {NWORDS} < 2000 THEN 'PASS' ELSE 'TOO_LONG' END AS length,
           CASE WHEN regexp_matches(clinical_handoff, '{UNSURE}') THEN 'UNCERTAIN' ELSE 'PASS' END AS uncertain,
           coalesce(list_max([len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''))
                     for s in regexp_split_to_array(clinical_handoff, '[.!?\\n]+')]), 0)::BIGINT AS longest_sentence
    FROM nar""")
def text_checks(t):
    x = F.col("clinical_handoff")
    return t.narratives.select(
        K, guardrails.dangerous_language(x, RISKY).alias("safety"), guardrails.completeness(x, NEEDED).alias("complete"),
        guardrails.length_check(x, 2000).alias("length"), guardrails.uncertainty(x, DOUBT).alias("uncertain"),
        guardrails.longest_sentence(x).alias("longest_sentence"),
    )


QUALITY = f"""{HALL},
  chk AS (SELECT n.transition_id, coalesce(w.n, 0)::BIGINT AS n_unlisted, coalesce(w.n, 0) > 0 AS bad_term, {RISKY_SQL} AS bad_lang,
                 NOT ({FULL_SQL} AND (coalesce(a.n, 0) = 0 OR clinical_handoff ILIKE '%allerg%')) AS bad_part, {NWORDS} >= 2000 AS bad_len,
                 regexp_matches(clinical_handoff, '{UNSURE}') AS bad_doubt
          FROM nar n LEFT JOIN (SELECT transition_id, count(*) AS n FROM wrong GROUP BY 1) w USING (transition_id)
          LEFT JOIN acount a USING (transition_id)),
  quality AS (SELECT transition_id, n_unlisted, CASE WHEN bad_lang THEN 'BLOCK_PHARMACIST_REVIEW' WHEN bad_term THEN 'INVALID_HUMAN_REVIEW'
       WHEN bad_part THEN 'MARK_INCOMPLETE' WHEN bad_len THEN 'REGENERATE' WHEN bad_doubt THEN 'PHYSICIAN_REVIEW' ELSE 'NONE' END AS action
       FROM chk)"""


@query("quality_checks", "nar acount", f"""
    WITH {QUALITY}
    SELECT transition_id, n_unlisted, action, CASE WHEN action = 'NONE' THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM quality""")
def quality_checks(t):
    allergies = cohort.active_counts(t.transitions, {"n_allergies": t.allergies})
    return guardrails.quality_checks(
        t.narratives, t.listed_terms, TERMS, allergies=allergies, dangerous=RISKY, required=NEEDED, uncertain=DOUBT
    ).select(K, "n_unlisted", "action", "verdict")
