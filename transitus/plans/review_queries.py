"""Review state, its reports, and the metrics over transitions and documents."""

from datetime import datetime

from pyspark.sql import functions as F

from transitus.functions.columns import count_if, mean, n_rows
from transitus.operators import approval, guardrails, metrics
from transitus.plans import narrative_queries as nq
from transitus.plans.registry import query
from transitus.sources.binding import add_days

K = "transition_id"
NOW = datetime(2024, 1, 30)


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sts(c, name=None):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


MOVES = " ".join(f"WHEN s.status = '{a}' AND e.act = '{b}' THEN '{c}'" for (a, b), c in approval.REVIEW.moves.items())
LEGAL = ", ".join(f"'{a}|{b}'" for a, b in [*approval.REVIEW.moves, *approval.REVIEW.stays])
STATE = f"""
  ord AS (SELECT *, CASE WHEN action = 'APPROVED' AND actor_role = 'MEDICAL_DIRECTOR' THEN '{approval.OVERRIDE}' ELSE action END AS act,
                 row_number() OVER (PARTITION BY transition_id ORDER BY action_at, log_id) AS rn FROM evt),
  run AS (SELECT e.transition_id, 0::BIGINT AS rn, 'DRAFT' AS status, FALSE AS ok, NULL::VARCHAR AS act, NULL::TIMESTAMP AS action_at,
                 NULL::VARCHAR AS actor, NULL::VARCHAR AS actor_role FROM (SELECT DISTINCT transition_id FROM evt) e
          UNION ALL
          SELECT s.transition_id, e.rn, CASE {MOVES} ELSE s.status END, s.status || '|' || e.act IN ({LEGAL}), e.act, e.action_at, e.actor, e.actor_role
          FROM run s JOIN ord e ON e.transition_id = s.transition_id AND e.rn = s.rn + 1),
  state AS (SELECT transition_id, arg_max(status, rn) AS status, max(rn)::BIGINT AS n_events, count_if(rn > 0 AND NOT ok)::BIGINT AS n_illegal,
      max(CASE WHEN ok AND act = 'ASSIGNED' THEN action_at END) AS assigned_at,
      arg_max(actor, CASE WHEN ok AND act = 'ASSIGNED' THEN rn END) AS assigned_to,
      arg_max(actor_role, CASE WHEN ok AND act = 'ASSIGNED' THEN rn END) AS assigned_role,
      max(CASE WHEN ok AND act LIKE 'APPROVED%' THEN action_at END) AS approved_at,
      arg_max(actor, CASE WHEN ok AND act LIKE 'APPROVED%' THEN rn END) AS reviewer_name,
      max(CASE WHEN ok AND act = 'REJECTED' THEN action_at END) AS rejected_at FROM run GROUP BY 1)"""
REC = "WITH RECURSIVE" + STATE


@query("approval_state", "evt", f"""{REC}
    SELECT transition_id, status, n_events, n_illegal, {sts('assigned_at')}, assigned_to, assigned_role, {sts('approved_at')}, reviewer_name,
           {sts('approved_at + INTERVAL 72 HOUR', 'approval_expiry')}, {sts('rejected_at')}, status = 'REJECTED' AS regeneration_requested
    FROM state""")
def approval_state(t):
    return t.review_state.select(
        K, "status", "n_events", "n_illegal", ts("assigned_at"), "assigned_to", "assigned_role", ts("approved_at"),
        "reviewer_name", ts("approval_expiry"), ts("rejected_at"), "regeneration_requested",
    )


ALLOWED = ", ".join(
    f"('{r}', '{a}', '{s}')" for r, acts in approval.ROLE_MATRIX.items() for a, docs in acts.items()
    for s in (approval.SECTIONS if docs == ["*"] else docs)
)


@query("authorize", "evt", f"""
    SELECT log_id, transition_id, action, actor_role, section, (actor_role, action, section) IN (VALUES {ALLOWED}) AS authorized FROM evt""")
def authorize(t):
    return approval.authorize(t.review_events).select("log_id", K, "action", "actor_role", "section", "authorized")


@query("route_reviews", "nar", f"""
    WITH {nq.HALL}, chk AS (SELECT n.transition_id, risk_tier, CASE WHEN {nq.RISKY_SQL} OR NOT ({nq.FULL_SQL}) OR {nq.NWORDS} >= 2000
           OR regexp_matches(clinical_handoff, '{nq.UNSURE}') OR EXISTS (SELECT 1 FROM wrong w WHERE w.transition_id = n.transition_id)
           THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM nar n)
    SELECT transition_id, risk_tier, CASE WHEN verdict = 'FAILED' THEN 'MEDICAL_DIRECTOR' WHEN risk_tier = 'HIGH' THEN 'MD,MEDICAL_DIRECTOR'
           WHEN risk_tier = 'MEDIUM' THEN 'NP,MD' ELSE 'NP,RN' END AS route_to,
           CASE risk_tier WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 8 ELSE 12 END::BIGINT AS escalate_after_hours,
           verdict = 'FAILED' AS send_blocked FROM chk""")
def route_reviews(t):
    return approval.route_reviews(t.narratives, t.checks)


@query("expired_approvals", "evt", f"""{REC}
    SELECT transition_id, {sts('approved_at')}, {sts('approved_at + INTERVAL 72 HOUR', 'approval_expiry')}, reviewer_name
    FROM state WHERE status = 'APPROVED' AND approved_at + INTERVAL 72 HOUR < TIMESTAMP '2024-01-30'""")
def expired_approvals(t):
    return approval.expired_approvals(t.review_state, NOW).select(K, ts("approved_at"), ts("approval_expiry"), "reviewer_name")


@query("sla_breaches", "evt nar", f"""{REC}
    SELECT transition_id, risk_tier, assigned_to, {sts('esc', 'escalate_at')} FROM (
      SELECT s.*, n.risk_tier, assigned_at + CASE n.risk_tier WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 8 ELSE 12 END * INTERVAL 1 HOUR AS esc
      FROM state s JOIN nar n USING (transition_id) WHERE status = 'IN_REVIEW') WHERE esc < TIMESTAMP '2024-01-30'""")
def sla_breaches(t):
    return approval.sla_breaches(t.review_state, t.narratives, NOW).select(K, "risk_tier", "assigned_to", ts("escalate_at"))


# The order dates end 23 years before the review events; both fact tables are moved by the same number of days.
SHIFT = 8300


@query("invalidated", "evt enc med", f"""{REC}
    SELECT transition_id, {sts('approved_at')}, e.m > approved_at AS new_encounter, coalesce(d.m > approved_at, FALSE) AS new_medication
    FROM state s JOIN (SELECT patient_id, max(start_at) + INTERVAL {SHIFT} DAY AS m FROM enc GROUP BY 1) e ON e.patient_id = s.transition_id
    LEFT JOIN (SELECT patient_id, max(start_at) + INTERVAL {SHIFT} DAY AS m FROM med GROUP BY 1) d ON d.patient_id = s.transition_id
    WHERE status = 'APPROVED' AND (e.m > approved_at OR d.m > approved_at)""")
def invalidated(t):
    state = t.review_state.withColumn("patient_id", F.col(K))
    moved = [df.withColumn("start_at", add_days("start_at", F.lit(SHIFT))) for df in (t.encounters, t.medications)]
    return approval.invalidated(state, *moved).select(K, ts("approved_at"), "new_encounter", "new_medication")


@query("digital_signature", "evt nar", f"""{REC}
    SELECT transition_id, sha256(coalesce(reviewer_name, '') || '|' || transition_id || '|' ||
           coalesce(strftime(approved_at, '%Y-%m-%d %H:%M:%S'), '') || '|' || clinical_handoff) AS digital_signature,
           reviewer_name IS NULL OR approved_at IS NULL AS unsigned, TRUE AS verified
    FROM state JOIN nar USING (transition_id) WHERE status IN ('APPROVED', 'SENT')""")
def digital_signature(t):
    signed = approval.sign(t.review_state, t.narratives)
    return signed.join(approval.verify_signature(signed, t.narratives), K).select(K, "digital_signature", "unsigned", "verified")


@query("edit_rate", "evt edit", f"""{REC}
    SELECT section, count(*)::BIGINT AS times_edited, count(DISTINCT transition_id)::BIGINT AS documents_edited,
           count(*)::DOUBLE * 100.0 / (SELECT count(*) FROM state WHERE status = 'APPROVED')::DOUBLE AS edit_rate_pct,
           count(DISTINCT transition_id)::DOUBLE * 100.0 / (SELECT count(*) FROM state WHERE status = 'APPROVED')::DOUBLE AS document_edit_rate_pct,
           count(*)::DOUBLE * 100.0 / (SELECT count(*) FROM state WHERE status = 'APPROVED')::DOUBLE > 30 AS alert
    FROM edit GROUP BY section""")
def edit_rate(t):
    return approval.edit_rate(t.edits, t.review_state)


@query("edit_diff", "edit", """
    WITH w AS (SELECT transition_id, edit_id, section,
        list_distinct(list_filter(regexp_split_to_array(lower(original_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS a,
        list_distinct(list_filter(regexp_split_to_array(lower(edited_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS b FROM edit),
    n AS (SELECT transition_id, edit_id, section, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS added,
        len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS removed, len(list_filter(a, lambda x: list_contains(b, x)))::BIGINT AS kept FROM w)
    SELECT *, CASE WHEN added = 0 AND removed = 0 THEN 'NONE' WHEN removed = 0 THEN 'ADDITION' WHEN added = 0 THEN 'REMOVAL'
                   WHEN kept < removed THEN 'REWRITE' ELSE 'CORRECTION' END AS edit_type FROM n""")
def edit_diff(t):
    return approval.edit_diff(t.edits)


@query("edit_alignment")
def edit_alignment(t):
    """An alignment is a loop over two texts; SQL has none for words. Held against a full table of costs in the tests."""
    return approval.edit_alignment(t.edits)


@query("spot_check", "evt", f"""{REC}
    SELECT transition_id, status FROM state WHERE status IN ('APPROVED', 'SENT')
       AND ('0x' || substr(sha256(transition_id || '|2024-01'), 1, 8))::BIGINT % 10 = 0""")
def spot_check(t):
    return approval.spot_check(t.review_state, "2024-01")


@query("audit_trail", "evt", f"""
    SELECT action, actor, actor_role, {sts('action_at')}, details FROM evt ORDER BY evt.action_at DESC, log_id DESC LIMIT 20""")
def audit_trail(t):
    return approval.audit_trail(t.review_events).withColumn("action_at", ts("action_at"))


LATENCY = """SELECT count(*)::BIGINT AS documents, sum(date_diff('microsecond', assigned_at, approved_at))::DOUBLE / (count(*) * 3600000000)::DOUBLE AS avg_hours
    FROM state WHERE approved_at IS NOT NULL AND assigned_at <= approved_at"""


@query("approval_latency", "evt", f"{REC} {LATENCY}")
def approval_latency(t):
    return approval.approval_latency(t.review_state)


@query("monitor_thresholds", "evt edit nar", f"""{REC}, {nq.HALL},
    m AS (SELECT 'hallucination_rate_pct' AS metric, (SELECT count(DISTINCT transition_id) FROM wrong)::DOUBLE * 100.0 / (SELECT count(*) FROM nar)::DOUBLE AS value
      UNION ALL SELECT 'edit_rate_pct', (SELECT count(DISTINCT transition_id) FROM edit)::DOUBLE * 100.0 / (SELECT count(*) FROM state WHERE status = 'APPROVED')::DOUBLE
      UNION ALL SELECT 'approval_hours', avg_hours FROM ({LATENCY}))
    SELECT metric, value, CASE WHEN value > a THEN 'ALERT' WHEN value >= g THEN 'ABOVE_TARGET' WHEN value IS NOT NULL THEN 'OK' END AS status,
           CASE WHEN value > a THEN act END AS action
    FROM m JOIN (VALUES ('hallucination_rate_pct', 2.0, 5.0, 'pause generation'), ('edit_rate_pct', 30.0, 50.0, 'retune prompts'),
                        ('approval_hours', 4.0, 24.0, 'staffing issue')) t(metric, g, a, act) USING (metric)""")
def monitor_thresholds(t):
    return guardrails.monitor_thresholds(approval.review_monitor(t.review_state, t.edits, t.checks))


@query("risk_distribution", "tier", """
    SELECT risk_tier, count(*)::BIGINT AS patient_count, round(count(*)::DOUBLE * 100.0 / sum(count(*)) OVER ()::DOUBLE, 1) AS pct
    FROM tier GROUP BY 1""")
def risk_distribution(t):
    return metrics.risk_distribution(t.tiers)


@query("tier_totals", "tier", """
    SELECT count(*)::BIGINT AS total, count_if(risk_tier = 'HIGH')::BIGINT AS high, count_if(risk_tier = 'MEDIUM')::BIGINT AS med,
           count_if(risk_tier = 'LOW')::BIGINT AS low FROM tier""")
def tier_totals(t):
    return metrics.tier_totals(t.tiers)


@query("readmission_by_tier", "nar trans", """
    SELECT risk_tier, count(*)::BIGINT AS transitions, count_if(readmitted)::BIGINT AS readmissions,
           round(count_if(readmitted)::DOUBLE * 100.0 / count(*)::DOUBLE, 2) AS readmission_rate_pct
    FROM nar JOIN trans USING (transition_id) GROUP BY 1""")
def readmission_by_tier(t):
    return metrics.readmission_by_tier(t.narratives, t.transitions)


@query("readmission_cost", "trans enc", """
    SELECT count(*)::BIGINT AS total_readmissions, round(sum(n.total_cost)::DOUBLE / count(n.total_cost)::DOUBLE, 2) AS avg_readmission_cost,
           round(sum(n.total_cost)::DOUBLE, 2) AS total_readmission_cost, round(sum(n.total_cost)::DOUBLE * 0.20::DOUBLE, 2) AS potential_savings
    FROM trans t LEFT JOIN enc n ON t.next_encounter_id = n.encounter_id WHERE t.readmitted""")
def readmission_cost(t):
    return metrics.readmission_cost(t.transitions, t.encounters)


@query("generation_stats", "nar", f"""
    SELECT count(*)::BIGINT AS total_narratives, {sts('min(generated_at)', 'earliest_generation')}, {sts('max(generated_at)', 'latest_generation')},
           count_if(clinical_handoff IS NOT NULL)::BIGINT AS with_clinical_handoff FROM nar""")
def generation_stats(t):
    out = metrics.generation_stats(t.narratives, ["clinical_handoff"])
    return out.withColumn("earliest_generation", ts("earliest_generation")).withColumn("latest_generation", ts("latest_generation"))


@query("approval_status_counts", "evt", f"{REC} SELECT status, count(*)::BIGINT AS cnt FROM state GROUP BY 1")
def approval_status_counts(t):
    return metrics.status_counts(t.review_state)


@query("readmission_rate", "trans", "SELECT round(count_if(readmitted)::DOUBLE * 100.0 / count(*)::DOUBLE, 1) AS rate FROM trans")
def readmission_rate(t):
    return metrics.readmission_rate(t.transitions)


@query("review_queue", "evt nar trans cohort", f"""{REC}
    SELECT transition_id, s.status, s.assigned_to, s.assigned_role, n.risk_tier, c.patient_name, c.age, c.gender, t.from_setting,
           t.length_of_stay, {sts('s.assigned_at', 'assigned_at')}, c.patient_id
    FROM state s JOIN nar n USING (transition_id) JOIN trans t USING (transition_id) JOIN cohort c ON c.patient_id = t.patient_id""")
def review_queue(t):
    return metrics.review_queue(t.review_state, t.narratives, t.cohort, t.transitions).withColumn("assigned_at", ts("assigned_at"))


@query("patient_list", "evt nar trans cohort", f"""{REC}
    SELECT transition_id, c.patient_id, n.risk_tier, {sts('n.generated_at', 'generated_at')}, c.patient_name, c.age, c.gender,
           s.status AS approval_status, s.assigned_to
    FROM nar n JOIN trans t USING (transition_id) JOIN cohort c ON c.patient_id = t.patient_id LEFT JOIN state s USING (transition_id)""")
def patient_list(t):
    return metrics.patient_list(t.narratives, t.transitions, t.cohort, t.review_state).withColumn("generated_at", ts("generated_at"))


@query("narrative_detail", "evt nar trans cohort", f"""{REC}
    SELECT transition_id, c.patient_id, n.risk_tier, sha256(n.clinical_handoff) AS handoff_hash, c.patient_name, c.age, t.from_setting, t.length_of_stay,
           t.readmitted, s.status AS approval_status, s.reviewer_name, {sts('s.approved_at', 'approved_at')}
    FROM nar n JOIN trans t USING (transition_id) JOIN cohort c ON c.patient_id = t.patient_id LEFT JOIN state s USING (transition_id)""")
def narrative_detail(t):
    return metrics.narrative_detail(t.narratives, t.transitions, t.cohort, t.review_state).select(
        K, "patient_id", "risk_tier", F.sha2("clinical_handoff", 256).alias("handoff_hash"), "patient_name", "age", "from_setting",
        "length_of_stay", "readmitted", "approval_status", "reviewer_name", ts("approved_at"),
    )


@query("review_rates", "evt edit", f"""{REC}
    SELECT round(count_if(status = 'APPROVED')::DOUBLE * 100.0 / count(*)::DOUBLE, 1) AS approval_rate,
           round(count_if(status = 'REJECTED')::DOUBLE * 100.0 / count(*)::DOUBLE, 1) AS rejection_rate,
           (SELECT count(*) FROM edit)::BIGINT AS edits FROM state""")
def review_rates(t):
    return metrics.review_rates(t.review_state, t.edits)


@query("readmission_with_document", "trans nar", """
    SELECT n.transition_id IS NOT NULL AS has_document, count(*)::BIGINT AS transitions, count_if(readmitted)::BIGINT AS readmissions,
           count_if(readmitted)::DOUBLE * 100.0 / count(*)::DOUBLE AS readmission_rate_pct
    FROM trans t LEFT JOIN nar n USING (transition_id) GROUP BY 1""")
def readmission_with_document(t):
    return metrics.readmission_with_document(t.transitions, t.narratives)


@query("facility_dashboard", "tier nar", """
    SELECT organization_id, strftime(admission_date, '%Y-%m-%d') AS day, count(*)::BIGINT AS transitions,
           count_if(t.risk_tier = 'HIGH')::BIGINT AS high, count_if(t.risk_tier = 'MEDIUM')::BIGINT AS medium,
           count_if(t.risk_tier = 'LOW')::BIGINT AS low, count(n.transition_id)::DOUBLE * 100.0 / count(*)::DOUBLE AS document_pct
    FROM tier t LEFT JOIN nar n USING (transition_id) GROUP BY ALL""")
def facility_dashboard(t):
    done = t.narratives.select(K, F.lit(True).alias("has_document"))
    rows = t.tiers.join(done, K, "left").withColumn("has_document", F.coalesce("has_document", F.lit(False)))
    return metrics.facility_dashboard(rows).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("metric_registry", "trans", """
    SELECT current_setting, coalesce(from_setting, 'none') AS from_setting, count(*)::BIGINT AS stays, count_if(readmitted)::BIGINT AS readmissions,
           sum(length_of_stay)::DOUBLE / nullif(count(length_of_stay), 0)::DOUBLE AS avg_los FROM trans GROUP BY ALL""")
def metric_registry(t):
    registry = metrics.MetricRegistry(
        t.transitions,
        measures={"stays": n_rows(), "readmissions": count_if(F.col("readmitted")), "avg_los": mean("length_of_stay")},
        dimensions={"current_setting": F.col("current_setting"), "from_setting": F.coalesce("from_setting", F.lit("none")),
                    "month": F.trunc("admission_date", "month")},
    )
    return registry.ask(["stays", "readmissions", "avg_los"], by=["current_setting", "from_setting"])
