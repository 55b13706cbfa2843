"""Document review as an append-only event log, and everything read from it.

Events: (log_id, transition_id, action, actor, actor_role, action_at, …). No row is ever updated; the state of a
document is the fold of its events in (action_at, log_id) order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.functions.columns import count_if, lookup, n_rows, pct, ratio, rules
from transitus.functions.skew import with_blocks
from transitus.functions.text import words

DIRECTOR = "MEDICAL_DIRECTOR"


@dataclass(frozen=True)
class Machine:
    """States, legal moves (state, action) → state, and the actions whose latest legal use is kept."""

    states: Sequence[str]
    moves: dict[tuple[str, str], str]
    stays: Sequence[tuple[str, str]] = ()
    marks: dict[str, Sequence[str]] = field(default_factory=dict)

    @property
    def initial(self) -> str:
        return self.states[0]

    def step(self, state: Column, action: Column) -> Column:
        out = F
        for (old, act), new in self.moves.items():
            out = out.when((state == old) & (action == act), new)
        return out.otherwise(state)

    def legal(self, state: Column, action: Column) -> Column:
        pairs = [*self.moves, *self.stays]
        return F.concat_ws("|", state, action).isin(*[f"{s}|{a}" for s, a in pairs])


OVERRIDE = "APPROVED_BY_DIRECTOR"
STATES = ["DRAFT", "IN_REVIEW", "APPROVED", "REJECTED", "SENT"]
STATE_ALIASES = {"REVIEWED": "IN_REVIEW"}
REVIEW = Machine(
    states=STATES,
    moves={
        ("DRAFT", "ASSIGNED"): "IN_REVIEW",
        ("IN_REVIEW", "APPROVED"): "APPROVED",
        ("IN_REVIEW", OVERRIDE): "APPROVED",
        ("IN_REVIEW", "REJECTED"): "REJECTED",
        ("REJECTED", "GENERATED"): "DRAFT",
        ("REJECTED", "ASSIGNED"): "IN_REVIEW",
        ("REJECTED", OVERRIDE): "APPROVED",
        ("APPROVED", "SENT"): "SENT",
    },
    stays=[("DRAFT", "GENERATED"), ("IN_REVIEW", "EDITED"), ("IN_REVIEW", "ASSIGNED"), *[(s, "VIEWED") for s in STATES]],
    marks={"assigned": ["ASSIGNED"], "approved": ["APPROVED", OVERRIDE], "rejected": ["REJECTED"],
           "sent": ["SENT"], "edited": ["EDITED"]},
)
EXPIRY_HOURS = 72
FOLD_ROWS = 50_000


def canonical_status(status: Column) -> Column:
    return F.coalesce(lookup(status, STATE_ALIASES), status)


def fold(events: DataFrame, machine: Machine, key: str, min_rows: int = FOLD_ROWS) -> DataFrame:
    """(key, status, n_events, n_illegal, one struct<at, actor, role> per mark) from ordered events.

    A step maps states to states, and such maps can be chained in any grouping. A key with very many events is
    therefore cut into days, and a day with very many into runs of at most `min_rows` events: each piece is first
    folded from every possible state, the pieces are chained to find the state each starts in, and each is folded
    once more from there. Other keys are one piece. `events` has key, at, id, action, actor, role; (at, id) must be
    unique within a key.
    """
    pieces = (
        with_blocks(events, [key], F.to_date("at"), ["at", "id"], min_rows)
        .groupBy(key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "id", "action", "actor", "role"))).alias("_events"))
    )
    states = F.array(*[F.lit(s) for s in machine.states])

    def end_from(start: str) -> Column:
        return F.aggregate("_events", F.lit(start), lambda s, e: machine.step(s, e["action"]))

    chains = (
        pieces.filter(F.col("_block").isNotNull())
        .select(key, F.struct("_block", F.array(*[end_from(s) for s in machine.states]).alias("ends")).alias("_link"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_link")).alias("_chain"))
        .select(key, F.inline(F.aggregate(
            "_chain",
            F.struct(F.lit(machine.initial).alias("s"), F.array().cast("array<struct<_block:struct<_cut:date,_run:bigint>,_start:string>>").alias("out")),
            lambda a, x: F.struct(
                F.element_at(x["ends"], F.array_position(states, a["s"]).cast("int")).alias("s"),
                F.concat(a["out"], F.array(F.struct(x["_block"].alias("_block"), a["s"].alias("_start")))).alias("out"),
            ),
            lambda a: a["out"],
        )))
    )
    mark_type = F.lit(None).cast("struct<at:timestamp,actor:string,role:string>")
    at_type = events.schema["at"].dataType.simpleString()
    mark_type = mark_type.cast(f"struct<at:{at_type},actor:string,role:string>")

    def merge(a: Column, e: Column) -> Column:
        fine = machine.legal(a["s"], e["action"])
        marks = [
            F.when(fine & e["action"].isin(*acts), F.struct(e["at"].alias("at"), e["actor"].alias("actor"), e["role"].alias("role")))
            .otherwise(a[name]).alias(name)
            for name, acts in machine.marks.items()
        ]
        return F.struct(
            machine.step(a["s"], e["action"]).alias("s"),
            (a["bad"] + F.when(fine, 0).otherwise(1)).alias("bad"), *marks,
        )

    zero = F.struct(
        F.coalesce("_start", F.lit(machine.initial)).alias("s"), F.lit(0).alias("bad"),
        *[mark_type.alias(n) for n in machine.marks],
    )
    folded = pieces.join(chains, [key, "_block"], "left").select(
        key, "_block", F.size("_events").alias("_n"), F.aggregate("_events", zero, merge).alias("_a")
    )
    return folded.groupBy(key).agg(
        F.max_by("_a.s", F.struct("_block")).alias("status"),
        F.sum("_n").cast("bigint").alias("n_events"),
        F.sum("_a.bad").cast("bigint").alias("n_illegal"),
        *[F.max(f"_a.{n}").alias(n) for n in machine.marks],
    )


def approval_state(events: DataFrame, min_rows: int = FOLD_ROWS) -> DataFrame:
    """One row per document: status, counts, who did what when, and the expiry of an approval.

    Illegal moves leave the state as it is and are counted. A director may approve a rejected document.
    """
    director = (F.col("action") == "APPROVED") & (F.col("actor_role") == DIRECTOR)
    log = events.select(
        "transition_id", F.col("action_at").alias("at"), F.col("log_id").alias("id"),
        F.when(director, OVERRIDE).otherwise(F.col("action")).alias("action"),
        F.col("actor"), F.col("actor_role").alias("role"),
    )
    return fold(log, REVIEW, "transition_id", min_rows).select(
        "transition_id", "status", "n_events", "n_illegal",
        F.col("assigned.at").alias("assigned_at"), F.col("assigned.actor").alias("assigned_to"),
        F.col("assigned.role").alias("assigned_role"),
        F.greatest("approved.at", "rejected.at").alias("reviewed_at"),
        F.col("approved.at").alias("approved_at"), F.col("approved.actor").alias("reviewer_name"),
        F.col("approved.role").alias("reviewer_credentials"),
        (F.col("approved.at") + F.make_dt_interval(F.lit(0), F.lit(EXPIRY_HOURS))).alias("approval_expiry"),
        F.col("rejected.at").alias("rejected_at"), F.col("sent.at").alias("sent_at"),
        F.col("edited.at").alias("last_edit_at"),
        (F.col("status") == "REJECTED").alias("regeneration_requested"),
    )


SECTIONS = ["clinical_handoff", "family_summary", "medication_reconciliation", "key_risks", "follow_up_actions"]
ANY = ["*"]
# Who may do what, on which document ("*" for all).
ROLE_MATRIX = {
    "SYSTEM": {"GENERATED": ANY, "ASSIGNED": ANY},
    "RN": {"VIEWED": ANY, "EDITED": ["clinical_handoff"]},
    "NP": {"VIEWED": ANY, "EDITED": ANY, "APPROVED": ["clinical_handoff"], "REJECTED": ["clinical_handoff"], "SENT": ANY},
    "MD": {"VIEWED": ANY, "EDITED": ANY, "APPROVED": ANY, "REJECTED": ANY, "SENT": ANY},
    "MEDICAL_DIRECTOR": {"VIEWED": ANY, "EDITED": ANY, "APPROVED": ANY, "REJECTED": ANY, "SENT": ANY, "ASSIGNED": ANY},
    "COORDINATOR": {"VIEWED": ["family_summary"], "EDITED": ["family_summary"], "SENT": ["family_summary"]},
    "FAMILY": {"VIEWED": ["family_summary"]},
}
# Fixed values: (roles that review, hours until escalation) per tier.
ROUTES = {"HIGH": ("MD,MEDICAL_DIRECTOR", 4), "MEDIUM": ("NP,MD", 8), "LOW": ("NP,RN", 12)}


def authorize(events: DataFrame, matrix: dict = ROLE_MATRIX, sections: list[str] = SECTIONS) -> DataFrame:
    """Events with `authorized`."""
    rows = [
        (role, action, section)
        for role, actions in matrix.items() for action, docs in actions.items()
        for section in (sections if docs == ANY else docs)
    ]
    allowed = rules(events.sparkSession, rows, "actor_role string, action string, section string").withColumn("_ok", F.lit(True))
    return (
        events.join(F.broadcast(allowed), ["actor_role", "action", "section"], "left")
        .withColumn("authorized", F.coalesce("_ok", F.lit(False))).drop("_ok")
    )


def route_reviews(narratives: DataFrame, checks: DataFrame) -> DataFrame:
    """Reviewer roles and hours until escalation by tier; a failed check goes to the director and blocks sending."""
    failed = F.coalesce(F.col("verdict") == "FAILED", F.lit(False))
    roles = lookup(F.col("risk_tier"), {t: r for t, (r, _) in ROUTES.items()})
    hours = lookup(F.col("risk_tier"), {t: h for t, (_, h) in ROUTES.items()})
    return narratives.select("transition_id", "risk_tier").join(
        checks.select("transition_id", "verdict"), "transition_id", "left"
    ).select(
        "transition_id", "risk_tier", F.when(failed, DIRECTOR).otherwise(roles).alias("route_to"),
        hours.cast("bigint").alias("escalate_after_hours"), failed.alias("send_blocked"),
    )


def expired_approvals(state: DataFrame, as_of: datetime) -> DataFrame:
    """Approved, not sent, and past the expiry at `as_of`."""
    late = (F.col("status") == "APPROVED") & (F.col("approval_expiry") < F.lit(as_of).cast(state.schema["approval_expiry"].dataType))
    return state.filter(late).select("transition_id", "approved_at", "approval_expiry", "reviewer_name")


def sla_breaches(state: DataFrame, narratives: DataFrame, as_of: datetime) -> DataFrame:
    """Documents under review longer than their tier allows, with the time of escalation."""
    hours = lookup(F.col("risk_tier"), {t: h for t, (_, h) in ROUTES.items()})
    now = F.lit(as_of).cast(state.schema["assigned_at"].dataType)
    return (
        state.filter(F.col("status") == "IN_REVIEW").select("transition_id", "assigned_at", "assigned_to")
        .join(narratives.select("transition_id", "risk_tier"), "transition_id")
        .withColumn("escalate_at", F.col("assigned_at") + F.make_dt_interval(F.lit(0), hours))
        .filter(F.col("escalate_at") < now)
    )


def invalidated(state: DataFrame, encounters: DataFrame, medications: DataFrame) -> DataFrame:
    """Approved documents of patients with an encounter or medication that started after the approval.

    Only the latest start per patient is needed, so both tables are reduced before the join.
    """
    latest = (
        encounters.select("patient_id", F.col("start_at").alias("_enc"), F.lit(None).cast(medications.schema["start_at"].dataType).alias("_med"))
        .unionAll(medications.select("patient_id", F.lit(None).cast(encounters.schema["start_at"].dataType), "start_at"))
        .groupBy("patient_id").agg(F.max("_enc").alias("_enc"), F.max("_med").alias("_med"))
    )
    by_encounter = F.coalesce(F.col("_enc") > F.col("approved_at"), F.lit(False))
    by_medication = F.coalesce(F.col("_med") > F.col("approved_at"), F.lit(False))
    return (
        state.filter(F.col("status") == "APPROVED").join(latest, "patient_id")
        .filter(by_encounter | by_medication)
        .select("transition_id", "patient_id", "approved_at", by_encounter.alias("new_encounter"), by_medication.alias("new_medication"))
    )


def signature(reviewer: Column, transition_id: Column, approved_at: Column, text: Column) -> Column:
    """SHA-256 over who, what document, when, and the text; a null part counts as empty."""
    parts = [reviewer, transition_id.cast("string"), F.date_format(approved_at, "yyyy-MM-dd HH:mm:ss"), text]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def sign(state: DataFrame, narratives: DataFrame, text: str = "clinical_handoff") -> DataFrame:
    """Signature of every approved or sent document; `unsigned` marks a missing part."""
    done = state.filter(F.col("status").isin("APPROVED", "SENT")).join(narratives.select("transition_id", text), "transition_id")
    return done.select(
        "transition_id", "reviewer_name", "approved_at",
        signature(F.col("reviewer_name"), F.col("transition_id"), F.col("approved_at"), F.col(text)).alias("digital_signature"),
        (F.col("reviewer_name").isNull() | F.col("approved_at").isNull() | F.col(text).isNull()).alias("unsigned"),
    )


def verify_signature(signed: DataFrame, narratives: DataFrame, text: str = "clinical_handoff") -> DataFrame:
    """Whether the text is still the one that was signed; a document that is gone does not verify."""
    again = signature(F.col("reviewer_name"), F.col("transition_id"), F.col("approved_at"), F.col(text))
    return signed.join(narratives.select("transition_id", text), "transition_id", "left").select(
        "transition_id", (F.col(text).isNotNull() & (again == F.col("digital_signature"))).alias("verified")
    )


def edit_rate(edits: DataFrame, state: DataFrame, alert_pct: float = 30.0) -> DataFrame:
    """Edits per section over approved documents; may exceed 100, so the share of edited documents is given too."""
    approved = state.filter(F.col("status") == "APPROVED").agg(n_rows()).scalar()
    return (
        edits.groupBy("section")
        .agg(n_rows().alias("times_edited"), F.count_distinct("transition_id").cast("bigint").alias("documents_edited"))
        .withColumn("edit_rate_pct", pct(F.col("times_edited"), approved))
        .withColumn("document_edit_rate_pct", pct(F.col("documents_edited"), approved))
        .withColumn("alert", F.coalesce(F.col("edit_rate_pct") > alert_pct, F.lit(False)))
        .orderBy(F.desc_nulls_last("times_edited"), "section")
    )


def edit_diff(edits: DataFrame) -> DataFrame:
    """Distinct words added, removed and kept by each edit, and the kind of edit that makes it."""
    pieces = edits.withColumn("_old", F.array_distinct(words("original_text"))).withColumn("_new", F.array_distinct(words("edited_text")))
    counted = pieces.select(
        "transition_id", "edit_id", "section",
        F.size(F.array_except("_new", "_old")).cast("bigint").alias("added"),
        F.size(F.array_except("_old", "_new")).cast("bigint").alias("removed"),
        F.size(F.array_intersect("_old", "_new")).cast("bigint").alias("kept"),
    )
    kind = (
        F.when((F.col("added") == 0) & (F.col("removed") == 0), "NONE")
        .when(F.col("removed") == 0, "ADDITION").when(F.col("added") == 0, "REMOVAL")
        .when(F.col("kept") < F.col("removed"), "REWRITE").otherwise("CORRECTION")
    )
    return counted.withColumn("edit_type", kind)


# One insertion or deletion in an alignment's cost; a replacement costs 1 more, so that fewer of them break ties.
EDIT = 1 << 31
FAR = 1 << 61


def align_words(before: Sequence[str], after: Sequence[str], band: int = 64) -> tuple[int, int, int, int]:
    """(inserted, deleted, replaced, kept) words of an ordered alignment of least edits, and of least replacements among those.

    Equal ends are set aside. The rest is aligned within a band of diagonals, which is doubled until the edits found
    fit into it: then no alignment outside can be better. Memory is one row of the band, time is words times edits.
    """
    n, m, lead = len(before), len(after), 0
    while lead < min(n, m) and before[lead] == after[lead]:
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and before[n - 1 - tail] == after[m - 1 - tail]:
        tail += 1
    before, after = before[lead:n - tail], after[lead:m - tail]
    n, m = len(before), len(after)
    if not n or not m:
        return m, n, 0, lead + tail
    codes: dict[str, int] = {}
    old = np.array([codes.setdefault(w, len(codes)) for w in before])
    new = np.array([codes.setdefault(w, len(codes)) for w in after])
    reach = max(band, abs(n - m))
    while True:
        reach = min(reach, max(n, m))
        cost = _banded(old, new, reach)
        edits, replaced = divmod(cost, EDIT)
        if edits <= reach:
            break
        reach *= 2
    inserted = (edits - replaced + m - n) // 2
    deleted = edits - replaced - inserted
    return inserted, deleted, replaced, lead + tail + n - deleted - replaced


def _banded(old: np.ndarray, new: np.ndarray, reach: int) -> int:
    """Least cost over alignments whose places differ by at most `reach`; cell k of row i is column i - reach + k."""
    n, m, width = len(old), len(new), 2 * reach + 1
    padded = np.concatenate([np.full(reach + 1, -1), new, np.full(n + reach + 1, -1)])
    along = np.arange(width, dtype=np.int64) * EDIT
    row = np.where(along >= reach * EDIT, along - reach * EDIT, FAR)
    for i in range(1, n + 1):
        across = row + np.where(padded[i:i + width] == old[i - 1], 0, EDIT + 1)
        across[:-1] = np.minimum(across[:-1], row[1:] + EDIT)
        row = np.minimum.accumulate(across - along) + along
    return int(row[m - n + reach])


def edit_alignment(edits: DataFrame) -> DataFrame:
    """Words inserted, deleted, replaced and kept in order by each edit, and the edits as a share of the longer text.

    Words are those of `edit_diff`, with their order and repetitions. A null text has no words; of two texts without
    words the share is null. Every edit is aligned whole, one at a time, on Arrow batches.
    """
    none = F.array().cast("array<string>")
    kind = "inserted long, deleted long, replaced long, kept long"

    @F.pandas_udf(kind)
    def aligned(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        rows = [align_words(list(a), list(b)) for a, b in zip(before, after, strict=True)]
        return pd.DataFrame(rows, columns=["inserted", "deleted", "replaced", "kept"])

    counted = edits.select(
        "transition_id", "edit_id", "section",
        aligned(F.coalesce(words("original_text"), none), F.coalesce(words("edited_text"), none)).alias("_n"),
    ).select("transition_id", "edit_id", "section", "_n.*")
    changed = F.col("inserted") + F.col("deleted") + F.col("replaced")
    longer = F.col("kept") + F.col("replaced") + F.greatest("inserted", "deleted")
    return counted.withColumns({"distance": changed, "changed_pct": pct(changed, longer)})


def spot_check(state: DataFrame, month: str, one_in: int = 10) -> DataFrame:
    """Approved documents drawn for the month; the same month draws the same documents again."""
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("transition_id").cast("string"), F.lit(month)), 256), 1, 8), 16, 10)
    return state.filter(F.col("status").isin("APPROVED", "SENT") & (draw.cast("bigint") % one_in == 0)).select("transition_id", "status")


def audit_trail(log: DataFrame, k: int = 20) -> DataFrame:
    return (
        log.orderBy(F.desc_nulls_last("action_at"), F.desc("log_id")).limit(k)
        .select("action", "actor", "actor_role", "action_at", "details")
    )


def approval_latency(state: DataFrame) -> DataFrame:
    """Average hours from assignment to approval, in exact microseconds before the division."""
    span = F.timestamp_diff("MICROSECOND", F.col("assigned_at"), F.col("approved_at"))
    done = state.filter(F.col("approved_at").isNotNull() & (F.col("assigned_at") <= F.col("approved_at")))
    return done.agg(n_rows().alias("documents"), ratio(F.sum(span), F.count(span) * 3_600_000_000).alias("avg_hours"))


def review_monitor(state: DataFrame, edits: DataFrame, checks: DataFrame) -> DataFrame:
    """(metric, value) rows for `guardrails.monitor_thresholds`."""
    wrong = checks.agg(pct(count_if(F.col("n_unlisted") > 0), n_rows()).alias("value")).select(
        F.lit("hallucination_rate_pct").alias("metric"), "value"
    )
    approved = state.filter(F.col("status") == "APPROVED").agg(n_rows()).scalar()
    edited = edits.agg(pct(F.count_distinct("transition_id"), approved).alias("value")).select(
        F.lit("edit_rate_pct").alias("metric"), "value"
    )
    wait = approval_latency(state).select(F.lit("approval_hours").alias("metric"), F.col("avg_hours").alias("value"))
    return wrong.unionAll(edited).unionAll(wait)
