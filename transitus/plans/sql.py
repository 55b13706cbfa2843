"""The binding of `transitus.sources.binding` as SQL common table expressions for DuckDB."""

from __future__ import annotations

CODE = ("chr((65 + p_partkey % 20)::INT) || lpad(((p_partkey // 20) % 100)::VARCHAR, 2, '0') || '.' || "
        "((p_partkey // 2000) % 1000)::VARCHAR")


def _pick(names: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


ROLES = ["RN", "NP", "MD", "MEDICAL_DIRECTOR", "COORDINATOR", "SYSTEM"]
SECTIONS = ["clinical_handoff", "family_summary", "medication_reconciliation", "key_risks", "follow_up_actions"]

# name: (names it needs, body)
CTES: dict[str, tuple[list[str], str]] = {
    "enc": ([], """
        SELECT o_orderkey AS encounter_id, o_custkey AS patient_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'emergency' WHEN '2' THEN 'inpatient'
                    WHEN '3' THEN 'snf' WHEN '4' THEN 'home' WHEN '5' THEN 'hospice' END AS encounter_class,
               o_orderdate AS start_at,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN NULL
                    ELSE o_orderdate + (o_orderkey % 30)::INT * INTERVAL 1 DAY END AS stop_at,
               o_totalprice::DECIMAL(18,2) AS total_cost, o_custkey % 10 AS organization_id
        FROM orders"""),
    "pat": ([], """
        SELECT c_custkey AS patient_id, c_name AS patient_name,
               DATE '1930-01-01' + (c_custkey % 20000)::INT AS birthdate,
               CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, n_name AS state,
               c_mktsegment AS payer, c_acctbal::DECIMAL(18,2) AS healthcare_expenses
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "fac": ([], """
        SELECT s_suppkey AS organization_id, s_name AS facility, n_name AS chain, s_acctbal::DECIMAL(18,2) AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "fact": ([], f"""
        SELECT o_custkey AS patient_id, o_orderkey AS encounter_id, {CODE} AS code, p_name AS description,
               p_brand AS drug_class, p_type AS category, l_shipdate AS start_at,
               CASE WHEN l_returnflag <> 'N' THEN l_shipdate + l_quantity::INT * INTERVAL 1 DAY END AS stop_at,
               l_quantity::BIGINT AS quantity, l_returnflag AS flag, l_linestatus AS kind, l_linenumber AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""),
    "cond": (["fact"], "SELECT patient_id, description, code, start_at, stop_at FROM fact WHERE kind = 'F'"),
    "med": (["fact"], "SELECT patient_id, description, code, description AS reason, start_at, stop_at "
                      "FROM fact WHERE kind = 'O'"),
    "alg": (["fact"], "SELECT patient_id, description, code, category, CASE WHEN quantity <= 2 THEN 'SEVERE' ELSE 'MILD' END "
                      "AS severity, start_at, stop_at FROM fact WHERE quantity <= 5"),
    "proc": (["fact"], "SELECT patient_id, code, category, start_at FROM fact WHERE line >= 6"),
    "obs": (["fact"], "SELECT patient_id, 'V' || line AS vital, quantity AS value, start_at AS observed_at, "
                      "code AS observation_id FROM fact"),
    "mds": (["fact"], "SELECT DISTINCT patient_id, code FROM fact WHERE kind = 'F' AND flag = 'A'"),
    "cat": ([], f"SELECT {CODE} AS code, p_name AS description, p_brand AS drug_class, p_type AS category, "
                "p_size AS size FROM part"),
    "clm": ([], """
        SELECT l_orderkey AS encounter_id, l_partkey AS part_id, l_linenumber AS line, o_orderdate AS service_at,
               l_shipdate AS billed_at, l_extendedprice::DECIMAL(18,2) AS charge,
               (CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2)
                ELSE 0 END)::DECIMAL(24,4) AS outstanding, l_linestatus AS line_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "clmdx": (["clm"], "SELECT clm.*, p_type AS diagnosis FROM clm JOIN part ON part_id = p_partkey"),
    "encpay": (["enc", "pat"], "SELECT enc.*, pat.payer FROM enc JOIN pat USING (patient_id)"),
    "cohort": (["enc", "pat"], """
        SELECT p.patient_id, p.patient_name, p.gender, p.state, p.payer,
               (year(DATE '2024-06-30') - year(p.birthdate))::BIGINT AS age,
               count(DISTINCT e.encounter_id)::BIGINT AS total_stays, min(e.start_at) AS first_admission,
               max(e.start_at) AS last_admission,
               sum(date_diff('day', e.start_at, e.stop_at))::DOUBLE / nullif(count(e.stop_at), 0)::DOUBLE AS avg_los_days,
               sum(e.total_cost)::DOUBLE AS total_cost
        FROM pat p JOIN enc e ON p.patient_id = e.patient_id AND e.encounter_class = 'snf'
        GROUP BY ALL"""),
    "seq": (["enc"], """
        SELECT *, lag(encounter_id) OVER w AS prev_encounter_id, lag(encounter_class) OVER w AS prev_setting,
               lag(stop_at) OVER w AS prev_discharge, lead(encounter_id) OVER w AS next_encounter_id,
               lead(encounter_class) OVER w AS next_setting, lead(start_at) OVER w AS next_admission
        FROM enc
        WHERE patient_id IN (SELECT patient_id FROM enc WHERE encounter_class = 'snf')
          AND encounter_class IN ('inpatient', 'snf', 'emergency', 'home', 'hospice')
        WINDOW w AS (PARTITION BY patient_id ORDER BY start_at, encounter_id)"""),
    "trans": (["seq"], """
        SELECT row_number() OVER (ORDER BY start_at, encounter_id)::BIGINT AS transition_id, patient_id, encounter_id,
               encounter_class AS current_setting, start_at AS admission_date, stop_at AS discharge_date,
               date_diff('day', start_at, stop_at)::BIGINT AS length_of_stay, total_cost, organization_id,
               prev_encounter_id, prev_setting AS from_setting, prev_discharge AS from_discharge_date,
               date_diff('day', prev_discharge, start_at)::BIGINT AS days_between_settings,
               next_encounter_id, next_setting AS to_setting, next_admission AS to_admission_date,
               date_diff('day', stop_at, next_admission)::BIGINT AS days_to_next_encounter,
               coalesce(next_setting IN ('inpatient', 'emergency')
                        AND date_diff('day', stop_at, next_admission) <= 30, FALSE) AS readmitted
        FROM seq WHERE encounter_class = 'snf'"""),
    "ccount": (["trans", "cond"], """
        SELECT t.transition_id, count(f.patient_id)::BIGINT AS n FROM trans t LEFT JOIN cond f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date) GROUP BY 1"""),
    "mcount": (["trans", "med"], """
        SELECT t.transition_id, count(f.patient_id)::BIGINT AS n FROM trans t LEFT JOIN med f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date) GROUP BY 1"""),
    "acount": (["trans", "alg"], """
        SELECT t.transition_id, count(f.patient_id)::BIGINT AS n FROM trans t LEFT JOIN alg f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date) GROUP BY 1"""),
    "prof": (["trans", "ccount", "mcount", "acount"], """
        SELECT t.*, c.n AS n_conditions, m.n AS n_medications, a.n AS n_allergies
        FROM trans t JOIN ccount c USING (transition_id) JOIN mcount m USING (transition_id)
        JOIN acount a USING (transition_id)"""),
    "tier": (["prof"], """
        SELECT *, CASE WHEN n_conditions >= 8 OR n_medications >= 10 OR readmitted THEN 'HIGH'
                       WHEN n_conditions >= 4 OR n_medications >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
        FROM prof"""),
    "actmed": (["trans", "med"], """
        SELECT t.transition_id, t.patient_id, f.code, f.description, f.reason FROM trans t JOIN med f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date)"""),
    "actcond": (["trans", "cond"], """
        SELECT t.transition_id, t.patient_id, f.code, f.description FROM trans t JOIN cond f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date)"""),
    "actalg": (["trans", "alg"], """
        SELECT t.transition_id, t.patient_id, f.code, f.description, f.category, f.severity FROM trans t JOIN alg f
          ON f.patient_id = t.patient_id AND f.start_at <= t.discharge_date
         AND (f.stop_at IS NULL OR f.stop_at >= t.admission_date)"""),
    "evt": ([], f"""
        SELECT event_id AS log_id, user_id * 8 + event_id % 8 AS transition_id,
               CASE event_type WHEN 'signup' THEN CASE WHEN (event_id // 8) % 3 = 0 THEN 'GENERATED' ELSE 'ASSIGNED' END
                    WHEN 'view' THEN 'VIEWED' WHEN 'click' THEN 'EDITED'
                    WHEN 'purchase' THEN CASE WHEN (event_id // 8) % 3 = 0 THEN 'SENT' ELSE 'APPROVED' END
                    WHEN 'error' THEN 'REJECTED' END AS action,
               'clinician-' || (event_id % 7) AS actor, {_pick(ROLES, "event_id % 6")} AS actor_role,
               {_pick(SECTIONS, "event_id % 5")} AS section, ts AS action_at, props AS details
        FROM events"""),
    "nar": ([], """
        SELECT d.doc_id AS transition_id, TIMESTAMP '2024-01-01' + (d.doc_id % 40000)::INT * INTERVAL 1 HOUR AS generated_at,
               CASE WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
               text AS clinical_handoff, source
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "edit": ([], f"""
        SELECT a.conv_id AS transition_id, a.turn AS edit_id, {_pick(SECTIONS, "(a.conv_id + a.turn) % 5")} AS section,
               a.text AS original_text, b.text AS edited_text
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'assistant' AND b.role = 'user'"""),
    "note": (["fact"], """
        SELECT patient_id, start_at AS noted_at, code,
               'Seen on ' || strftime(start_at, '%Y-%m-%d') || '. Reports ' || description ||
               CASE WHEN flag = 'R' THEN ' (' || code || ')' ELSE '' END ||
               CASE WHEN quantity >= 40 THEN '. Denies ' || category ELSE '' END || '. BMI ' || quantity || '.' AS text
        FROM fact WHERE kind = 'F'"""),
}


def with_(names: str, body: str) -> str:
    """`body` behind the WITH list of the named tables and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in CTES[name][0]:
                add(need)
            order.append(name)

    for name in names.split():
        add(name)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[14:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body}"
