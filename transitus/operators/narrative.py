"""Risk tier, prompts, batch generation and the documents written from templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds are ours: the wording "multiple comorbidities, medication complexity or prior readmission" names none.
TIER_RULES = {
    "HIGH": {"n_conditions": 8, "n_medications": 10, "readmitted": True},
    "MEDIUM": {"n_conditions": 4, "n_medications": 5, "readmitted": False},
}


def risk_tier(profiles: DataFrame, rules: dict[str, dict] = TIER_RULES, lowest: str = "LOW") -> DataFrame:
    """First tier with a rule that holds; `LOW` otherwise."""
    tier = F
    for name, rule in rules.items():
        hit = (F.col("n_conditions") >= rule["n_conditions"]) | (F.col("n_medications") >= rule["n_medications"])
        tier = tier.when(hit | F.col("readmitted") if rule["readmitted"] else hit, name)
    return profiles.withColumn("risk_tier", tier.otherwise(lowest))


# The text that stands in for a missing value, per document.
FALLBACKS = {
    "clinical_handoff": {"from_setting": "Unknown", "conditions": "None documented", "medications": "None documented",
                         "allergies": "No known allergies"},
    "family_summary": {"from_setting": "hospital", "conditions": "General care", "medications": "As prescribed"},
    "medication_reconciliation": {"conditions": "Not specified", "medications": "None listed", "allergies": "NKDA"},
    "key_risks": {"conditions": "None", "medications": "None"},
    "follow_up_actions": {"conditions": "General", "medications": "Standard"},
}
MISSING = "Not documented"

PROMPTS = {
    "clinical_handoff": (
        "Write a handoff for the receiving care team. Use only the facts below; write 'Not documented' for what is missing.\n"
        "Patient: {patient_name}, {age}, {gender}. Path: {from_setting} to {current_setting}. "
        "Stay: {admission_date} to {discharge_date}.\n"
        "Conditions: {conditions}\nMedications: {medications}\nAllergies: {allergies}\n"
        "Sections: CLINICAL SUMMARY, ACTIVE DIAGNOSES, CRITICAL MEDICATIONS, PRECAUTIONS & ALERTS, PENDING ITEMS."
    ),
    "family_summary": (
        "Explain to the family in plain words the move from {from_setting} to {current_setting}.\n"
        "Patient: {patient_name}, {age}. Being treated: {conditions}. Medicines: {medications}.\n"
        "Say what happened, what is treated, why each medicine is taken, the warning signs and what comes next. "
        "Short sentences, no jargon."
    ),
    "medication_reconciliation": (
        "Review the medicines as a pharmacist.\nPatient: {patient_name}, {age}, {gender}.\nConditions: {conditions}\n"
        "Medications: {medications}\nAllergies: {allergies}\n"
        "List the medicines by condition, interactions, allergy conflicts, monitoring and recommendations."
    ),
    "key_risks": (
        "Name the 3 to 5 main reasons why this patient may be readmitted.\nAge {age}, {gender}. Conditions: {conditions}. "
        "Medications: {medications}. Readmitted before: {readmitted}."
    ),
    "follow_up_actions": (
        "List follow-up actions for {patient_name}, {age}, {gender}, now in {current_setting}.\n"
        "Conditions: {conditions}. Medications: {medications}.\nGroup them: within 24 hours, 7 days, 30 days."
    ),
}

FOOTER = (
    "\n---\nGENERATED DOCUMENT: CLINICAL REVIEW REQUIRED BEFORE USE\nData as of {as_of}. "
    "Not reviewed by a licensed clinician. Not for clinical decisions without physician approval."
)

# The documents and their headings.
DOCUMENTS = {
    "clinical_handoff": (
        "CLINICAL SUMMARY\n{patient_name}, {age}, {gender}, moved from {from_setting} to {current_setting}; "
        "stay {admission_date} to {discharge_date}. Risk tier {risk_tier}.\n"
        "ACTIVE DIAGNOSES\n{conditions}\nCRITICAL MEDICATIONS\n{medications}\nPRECAUTIONS & ALERTS\nAllergies: {allergies}\n"
        "PENDING ITEMS\nNot documented" + FOOTER
    ),
    "family_summary": (
        "Dear Family,\nHERE'S WHAT HAPPENED\n{patient_name} came from {from_setting} to our {current_setting} team.\n"
        "CONDITIONS WE'RE MANAGING\n{conditions}\nMEDICATIONS\n{medications}\n"
        "WATCH FOR THESE WARNING SIGNS\nCall the nurse about any sudden change.\n"
        "WHAT TO EXPECT NEXT\nOur team will call you this week. We are here for you." + FOOTER
    ),
    "medication_reconciliation": (
        "CURRENT MEDICATION LIST\n{medications}\nFOR CONDITIONS\n{conditions}\nALLERGY REVIEW\n{allergies}" + FOOTER
    ),
    "key_risks": "Active conditions: {n_conditions}. Medications: {n_medications}. Readmitted: {readmitted}." + FOOTER,
    "follow_up_actions": (
        "WITHIN 24 HOURS\nReconcile medicines.\nWITHIN 7 DAYS\nPhysician visit.\nWITHIN 30 DAYS\nCare plan review." + FOOTER
    ),
}


def listing(items: Column | str, name: str, extra: str | None = None) -> Column:
    """Array of facts as one text: `name (code)`, with the number of copies above one."""

    def line(x: Column) -> Column:
        more = F.when(x["copies"] > 1, F.concat(F.lit(" x"), x["copies"].cast("string"))).otherwise(F.lit(""))
        reason = F.concat(F.lit(" for "), F.coalesce(x[extra], F.lit(MISSING))) if extra else F.lit("")
        return F.concat(
            F.coalesce(x[name], F.lit(MISSING)), F.lit(" ("), F.coalesce(x["code"], F.lit(MISSING)), F.lit(")"), reason, more
        )

    return F.nullif(F.array_join(F.transform(items, line), "; "), F.lit(""))


def whole_profiles(profiles: DataFrame) -> DataFrame:
    """One row per transition: the parts of its profile put together again, in the order of an undivided one."""
    arrays = ("active_conditions", "active_medications", "allergies")
    shared = [c for c in profiles.columns if c not in (*arrays, "transition_id", "part")]
    return profiles.groupBy("transition_id").agg(
        *[F.first(c).alias(c) for c in shared],
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in arrays],
    )


def prompt_variables(profiles: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row per transition with one text column per template variable, null where nothing is known in any part."""
    people = cohort.select("patient_id", "patient_name", "age", "gender")
    # texts travel to the patients, not arrays
    told = whole_profiles(profiles).select(
        "transition_id", "patient_id", "from_setting", "current_setting",
        F.date_format("admission_date", "yyyy-MM-dd").alias("admission_date"),
        F.date_format("discharge_date", "yyyy-MM-dd").alias("discharge_date"),
        F.col("readmitted").cast("string").alias("readmitted"),
        F.col("n_conditions").cast("string").alias("n_conditions"),
        F.col("n_medications").cast("string").alias("n_medications"),
        listing("active_conditions", "condition").alias("conditions"),
        listing("active_medications", "medication", "reason").alias("medications"),
        listing("allergies", "allergy").alias("allergies"),
        *[c for c in ("risk_tier",) if c in profiles.columns],
    )
    first = ["patient_name", F.col("age").cast("string").alias("age"), "gender"]
    rest = [c for c in told.columns if c not in ("transition_id", "patient_id")]
    return told.join(people, "patient_id").select("transition_id", "patient_id", *first, *rest)


def fill(template: str, fallbacks: dict[str, str], constants: dict[str, str] | None = None) -> Column:
    """Template text with `{column}` filled in; a null becomes its fallback, never a null document."""
    constants, pieces = constants or {}, []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            pieces.append(F.lit(piece))
        elif piece in constants:
            pieces.append(F.lit(constants[piece]))
        else:
            pieces.append(F.coalesce(F.col(piece), F.lit(fallbacks.get(piece, MISSING))))
    return F.concat(*pieces)


def render_prompts(variables: DataFrame, templates: dict[str, str] = PROMPTS) -> DataFrame:
    """(transition_id, section, prompt): one row per document."""
    return variables.select(
        "transition_id",
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("section"), fill(t, FALLBACKS.get(s, {})).alias("prompt"))
            for s, t in templates.items()
        ])),
    )


def template_narrative(variables: DataFrame, as_of: str, templates: dict[str, str] = DOCUMENTS) -> DataFrame:
    """Documents written from templates alone; stands in for a model."""
    return variables.select(
        "transition_id", "patient_id", *[c for c in ("risk_tier",) if c in variables.columns],
        *[fill(t, FALLBACKS.get(s, {}), {"as_of": as_of}).alias(s) for s, t in templates.items()],
    )


Backend = Callable[[list[str]], list[str]]

GENERATED = "prompt_hash string, output string, model string, error string"


def pending_prompts(prompts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Distinct prompts with no successful output yet."""
    todo = prompts.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").groupBy("prompt_hash").agg(
        F.min("prompt").alias("prompt")
    )
    if done is not None:
        todo = todo.join(done.filter(F.col("error").isNull()).select("prompt_hash"), "prompt_hash", "left_anti")
    return todo


def batch_generate(
    prompts: DataFrame, make_backend: Callable[[], Backend], model: str, done: DataFrame | None = None,
    batch: int = 32, tries: int = 2, tasks: int | None = None,
) -> DataFrame:
    """(prompt_hash, output, model, error) for every distinct prompt not done yet.

    `make_backend` is called once per task and gives a function from texts to texts. A batch that fails is
    tried again text by text; what still fails keeps its error and stays pending. Write the result with
    `sinks.append_new` so that a rerun goes on where the last one stopped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()

        def one(text: str) -> tuple[str | None, str | None]:
            error = ""
            for _ in range(tries):
                try:
                    return backend([text])[0], None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at:at + batch]
                texts = rows["prompt"].tolist()
                try:
                    results = [(text, None) for text in backend(texts)]
                    if len(results) != len(texts):
                        raise ValueError("backend returned another number of texts")
                except Exception:  # noqa: BLE001
                    results = [one(text) for text in texts]
                yield pd.DataFrame({
                    "prompt_hash": rows["prompt_hash"].tolist(),
                    "output": [r[0] for r in results], "model": model, "error": [r[1] for r in results],
                })

    todo = pending_prompts(prompts, done)
    todo = todo.repartition(tasks, "prompt_hash") if tasks else todo.repartition("prompt_hash")
    return todo.mapInPandas(run, GENERATED)


def attach_outputs(prompts: DataFrame, outputs: DataFrame, generated_at: datetime) -> DataFrame:
    """Outputs at their (transition, section); equal prompts share one output."""
    return (
        prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
        .join(outputs, "prompt_hash", "left").drop("prompt")
        .withColumn("generated_at", F.lit(generated_at))
    )


def narrative_preview(narratives: DataFrame, columns: list[str], n: int = 200, k: int = 10) -> DataFrame:
    """Newest `k` documents, first `n` characters of each text (a listing for the eye)."""
    return (
        narratives.orderBy(F.desc_nulls_last("generated_at"), F.desc("transition_id")).limit(k)
        .select("transition_id", "risk_tier", "generated_at", *[F.left(c, F.lit(n)).alias(f"{c}_preview") for c in columns])
    )


def first_narrative(narratives: DataFrame) -> DataFrame:
    """All columns of the document with the smallest transition id."""
    least = narratives.agg(F.min("transition_id").alias("transition_id"))
    return narratives.join(F.broadcast(least), "transition_id", "left_semi")


# The follow-up horizons in days.
HORIZONS = {"within 24 hours": 1, "within 7 days": 7, "within 30 days": 30}


def care_brief(transitions: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One action row per transition and horizon, due counted from discharge; open stays have no due date."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("_days")) for h, n in horizons.items()])
    return transitions.select("transition_id", "patient_id", "discharge_date", F.inline(rows)).select(
        "transition_id", "patient_id", "horizon",
        F.date_add(F.to_date("discharge_date"), F.col("_days")).alias("due_date"),
    )
