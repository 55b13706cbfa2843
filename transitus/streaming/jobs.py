"""Streaming jobs. Each takes and gives streaming DataFrames, so source, sink and trigger stay with the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from transitus.functions.columns import count_if, lookup, n_rows, pct
from transitus.functions.skew import neighbours
from transitus.operators.approval import EXPIRY_HOURS, ROUTES
from transitus.operators.narrative import Backend, batch_generate

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 day"


def read_stream(spark, folder: str, schema, files_per_batch: int | None = None, only: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; zone-free timestamps become instants, as watermarks need them.

    `only` is a pattern of file names.
    """
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, d in df.dtypes if d == "timestamp_ntz"})


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process all files there are, append the result as parquet and stop; a rerun goes on from the checkpoint."""
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def generate_new(
    prompts: DataFrame, out: str, checkpoint: str, make_backend: Callable[[], Backend], model: str
) -> None:
    """Generate texts for prompts that have none yet.

    Each micro-batch writes its own folder in overwrite mode, so a batch that is run again after a failure
    replaces its first try.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, None
        if batch_id:
            # one root for all batches: a folder that is missing or of a first try of this batch does no harm
            done = (
                spark.read.schema("prompt_hash string, error string, batch bigint").parquet(out)
                .filter(F.col("batch") < batch_id).drop("batch")
            )
        batch_generate(batch, make_backend, model, done).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        prompts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


CLOCK_EVENTS = {
    # clock: (events that start it anew, events that stop it)
    "ESCALATE": (["ASSIGNED"], ["APPROVED", "REJECTED"]),
    "EXPIRE": (["APPROVED"], ["SENT", "REJECTED", "GENERATED"]),
}
ALERT = "transition_id bigint, kind string, started_at timestamp, due_at timestamp, change string"
HOUR_US = 3_600_000_000


def play(clocks: dict[str, tuple[int, int] | None], events: list[tuple]) -> tuple[dict, list[tuple]]:
    """The clocks after `events` (at_us, log_id, action, hours; sorted) and the alerts (kind, start, due) they show."""
    clocks, alerts = dict(clocks), []
    for at, _, action, hours in events:
        for kind, (starts, stops) in CLOCK_EVENTS.items():
            running = clocks[kind]
            if running and running[1] < at:
                alerts.append((kind, *running))
                clocks[kind] = None
            if action in starts:
                clocks[kind] = (at, at + (hours if kind == "ESCALATE" else EXPIRY_HOURS) * HOUR_US)
            elif action in stops:
                clocks[kind] = None
    return clocks, alerts


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def instant(at_us: int) -> datetime:
    return EPOCH + timedelta(microseconds=at_us)


class Clocks(StatefulProcessor):
    """Per document two clocks, kept as start and due in microseconds; an `ALERT` is sent when one runs out.

    The clocks stand at the watermark. Events beyond it are kept and played from there anew, in order of time and
    log_id, whenever more come, so it does not matter in which batch they came. Alerts sent for what lies beyond
    the watermark are kept until it passes their due time; they are not sent twice, and one that an event from before
    it takes away meanwhile is sent as `WITHDRAWN`. Behind the watermark nothing changes any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = list(CLOCK_EVENTS)
        # one value: each further state or timer costs a call to the state store for every document
        self.state = handle.getValueState(
            "review",
            ", ".join(f"{k}_start bigint, {k}_due bigint" for k in self.kinds)
            + ", timer_ms bigint, waiting array<struct<at_us: bigint, log_id: bigint, action: string, hours: bigint>>"
            + ", told array<struct<kind: string, start: bigint, due: bigint>>",
        )

    def _load(self) -> tuple[dict[str, tuple[int, int] | None], int | None, list[tuple], list[tuple]]:
        row = self.state.get()
        if row is None:
            return dict.fromkeys(self.kinds), None, [], []
        clocks = {k: None if row[2 * i] is None else (row[2 * i], row[2 * i + 1]) for i, k in enumerate(self.kinds)}
        timer, waiting, told = row[2 * len(self.kinds):]
        return clocks, timer, [tuple(e) for e in waiting], [tuple(t) for t in told]

    def _settle(self, key: tuple, fresh: list[tuple], now: int, fired: int | None = None) -> Iterator[Row]:
        """Move the clocks to `now`, play what lies beyond and send the alerts that were not sent before."""
        clocks, timer, waiting, told = self._load()
        events = sorted(waiting + fresh)
        later = [e for e in events if e[0] > now]
        clocks, alerts = play(clocks, [e for e in events if e[0] <= now])
        for kind, running in clocks.items():
            if running and running[1] <= now:
                alerts.append((kind, *running))
                clocks[kind] = None
        ahead, shown = play(clocks, later)
        standing = set(alerts + shown)
        gone = [t for t in told if t not in standing]
        told = [t for t in told if t in standing]
        alerts = [a for a in alerts + shown if a not in told]
        due = [running[1] for running in ahead.values() if running]
        # a timer counts in milliseconds and must not fire early
        wanted = -(-min(due) // 1000) if due else None
        if wanted != timer or fired == timer:
            if timer is not None and fired != timer:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        kept = [t for t in told + alerts if t[2] > now]
        self.state.update((*(x for k in self.kinds for x in (clocks[k] or (None, None))), wanted, later, kept))
        for change, rows in (("WITHDRAWN", gone), ("ALERT", alerts)):
            for kind, start, end in rows:
                yield Row(transition_id=key[0], kind=kind, started_at=instant(start), due_at=instant(end), change=change)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r["at_us"], r["log_id"], r["action"], r["sla_hours"]) for r in rows]
        yield from self._settle(key, fresh, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())
        yield from self._settle(key, [], now * 1000, fired)

    def close(self) -> None:
        pass


def sla_hours(tier: Column) -> Column:
    """Hours until escalation; a document without a tier is treated as one of high risk."""
    return F.coalesce(lookup(tier, {t: h for t, (_, h) in ROUTES.items()}), F.lit(ROUTES["HIGH"][1]))


def review_clocks(events: DataFrame, tiers: DataFrame, late: str = LATE) -> DataFrame:
    """A changelog (`ALERT`) of alerts for reviews past their limit and approvals past their expiry.

    `events` is a stream with log_id, transition_id, action, action_at; `tiers` is static. Needs the RocksDB state
    store (`STATE_STORE`). An alert is sent once the watermark has passed its due time, or as soon as a later event
    of the document shows it to be due; if an event from before its due time comes later still, the early alert is
    withdrawn by a second row. `standing_alerts` folds the changelog.
    Events without a time are left out, those later than the watermark allows are dropped, all others may come in
    any order.
    """
    rows = (
        events.filter(F.col("action").isin(*sorted({a for s, e in CLOCK_EVENTS.values() for a in (*s, *e)})))
        .filter(F.col("action_at").isNotNull())
        .withWatermark("action_at", late)
        .join(tiers.select("transition_id", "risk_tier"), "transition_id", "left")
        .select("transition_id", "action_at", F.coalesce(F.col("log_id").cast("bigint"), F.lit(0)).alias("log_id"), "action", F.unix_micros("action_at").alias("at_us"),
                sla_hours(F.col("risk_tier")).alias("sla_hours"))
    )
    return rows.groupBy("transition_id").transformWithState(
        statefulProcessor=Clocks(), outputStructType=ALERT, outputMode="Append", timeMode="EventTime"
    )


def standing_alerts(changes: DataFrame) -> DataFrame:
    """The alerts of a changelog that were not withdrawn, each once. Groups are summed before they are shuffled."""
    alert = ["transition_id", "kind", "started_at", "due_at"]
    sign = F.when(F.col("change") == "ALERT", 1).otherwise(-1)
    return changes.groupBy(*alert).agg(F.sum(sign).alias("_n")).filter("_n > 0").select(*alert)


def review_clocks_batch(events: DataFrame, tiers: DataFrame, until: Column) -> DataFrame:
    """Batch twin: each start whose due time comes before the next event of its clock and not after `until`."""
    out = None
    rows = events.join(tiers.select("transition_id", "risk_tier"), "transition_id", "left").withColumn(
        "_hours", sla_hours(F.col("risk_tier"))
    )
    for kind, (starts, stops) in CLOCK_EVENTS.items():
        linked = neighbours(
            rows.filter(F.col("action").isin(*starts, *stops)), ["transition_id"], ["action_at", "log_id"],
            F.to_date("action_at"), ["action_at"],
        )
        hours = F.col("_hours") if kind == "ESCALATE" else F.lit(EXPIRY_HOURS)
        due = F.col("action_at") + F.make_dt_interval(F.lit(0), hours)
        ends = F.col("_next.action_at")
        part = linked.filter(F.col("action").isin(*starts) & (due <= until) & (ends.isNull() | (ends > due))).select(
            "transition_id", F.lit(kind).alias("kind"), F.col("action_at").alias("started_at"), due.alias("due_at")
        )
        out = part if out is None else out.unionAll(part)
    return out


def invalidations(approvals: DataFrame, changes: DataFrame | dict[str, DataFrame], late: str = LATE) -> DataFrame:
    """Approvals followed by a new encounter or medication of the patient before they expire.

    Streams: approvals (transition_id, patient_id, approved_at) and changes (patient_id, start_at), the latter as one
    stream or one for each `kind`, which is then a column of the result. The time bound lets both sides drop old state.
    Each stream has a watermark of its own, and the earliest of them holds (`spark.sql.streaming.multipleWatermarkPolicy`
    is `min` unless set otherwise), so a kind that runs ahead drops nothing of the others.
    """
    a = approvals.withWatermark("approved_at", late)
    if isinstance(changes, dict):
        c = None
        for kind, stream in changes.items():
            one = stream.select("patient_id", "start_at", F.lit(kind).alias("kind")).withWatermark("start_at", late)
            c = one if c is None else c.unionByName(one)
    else:
        c = changes.withWatermark("start_at", late)
    c = c.withColumnRenamed("patient_id", "_patient")
    return a.join(
        c,
        (F.col("patient_id") == F.col("_patient")) & (F.col("start_at") > F.col("approved_at"))
        & (F.col("start_at") <= F.col("approved_at") + F.expr(f"INTERVAL {EXPIRY_HOURS} HOURS")),
    ).drop("_patient")


def invalidations_batch(approvals: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.withColumnRenamed("patient_id", "_patient")
    return approvals.join(
        c,
        (F.col("patient_id") == F.col("_patient")) & (F.col("start_at") > F.col("approved_at"))
        & (F.col("start_at") <= F.col("approved_at") + F.expr(f"INTERVAL {EXPIRY_HOURS} HOURS")),
    ).drop("_patient")


def distinct_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """Review events, each once, whatever was delivered twice; ids are remembered as long as the watermark allows."""
    return events.withWatermark("action_at", late).dropDuplicates(["log_id", "action_at"])


def sliding_monitor(events: DataFrame, edit_target: float = 30.0, edit_alert: float = 50.0, late: str | None = LATE) -> DataFrame:
    """Edits and rejections per approval over 7 days, every day, with the alert status. `late=None` for batch input."""
    action = F.col("action")
    rate = pct(F.col("edits"), F.col("approvals"))
    src = events if late is None else events.withWatermark("action_at", late)
    return (
        src.groupBy(F.window("action_at", "7 days", "1 day").alias("w"))
        .agg(
            n_rows().alias("events"), count_if(action == "EDITED").alias("edits"),
            count_if(action == "APPROVED").alias("approvals"), count_if(action == "REJECTED").alias("rejections"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "edits", "approvals", "rejections",
            rate.alias("edit_rate_pct"),
            F.when(rate > edit_alert, "ALERT").when(rate >= edit_target, "ABOVE_TARGET").when(rate.isNotNull(), "OK").alias("status"),
        )
    )


def daily_volume(transitions: DataFrame, late: str | None = LATE) -> DataFrame:
    """Transitions per facility and day of admission. `late=None` for batch input."""
    src = transitions if late is None else transitions.withWatermark("admission_date", late)
    return src.groupBy(F.window("admission_date", "1 day").alias("w"), "organization_id").agg(
        n_rows().alias("transitions")
    ).select(F.col("w.start").alias("day"), "organization_id", "transitions")


def flag_undercoding(assessments: DataFrame, gaps: DataFrame, within_hours: int = 24) -> DataFrame:
    """Under-coded patients among new assessments (patient_id, assessed_at, seen_at); `gaps` is static."""
    due = F.col("assessed_at") + F.expr(f"INTERVAL {within_hours} HOURS")
    return assessments.join(gaps.filter("undercoded").select("patient_id", "daily_gap"), "patient_id").withColumn(
        "late", F.col("seen_at") > due
    )
