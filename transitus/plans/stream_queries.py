"""Streaming jobs run over the whole driver tables with `availableNow`, their output read back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from transitus.plans import money_queries, narrative_queries
from transitus.plans.registry import query
from transitus.plans.review_queries import SHIFT, sts, ts
from transitus.session import shared_folder
from transitus.sources.binding import action_of, add_days, document_of
from transitus.streaming import jobs, progress


def streamed(t, name):
    """A table as a stream, be it one file or a folder of files: a pattern matches either."""
    return jobs.read_stream(t.spark, f"{t.folder}/{name}.parque[t]", t.table(name).schema)


def result(t, df, name):
    base = f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jobs.run_available(df, f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


def event_stream(t):
    return streamed(t, "events").select(
        F.col("event_id").alias("log_id"), document_of("user_id", "event_id").alias("transition_id"),
        action_of("event_type", "event_id").alias("action"), F.col("ts").alias("action_at"),
    )


# The watermark: latest event less the allowed lateness, in whole milliseconds.
MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"


@query("stream_sliding_monitor", "evt", f"""
    WITH d AS (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 6 DAY, date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS a FROM events),
    w AS (SELECT a, a + INTERVAL 7 DAY AS b, count(*)::BIGINT AS events, count_if(action = 'EDITED')::BIGINT AS edits, count_if(action = 'APPROVED')::BIGINT AS approvals,
            count_if(action = 'REJECTED')::BIGINT AS rejections FROM d JOIN evt ON action_at >= a AND action_at < a + INTERVAL 7 DAY GROUP BY ALL),
    r AS (SELECT *, edits::DOUBLE * 100.0 / nullif(approvals, 0)::DOUBLE AS rate FROM w WHERE b <= {MARK})
    SELECT {sts('a', 'window_start')}, {sts('b', 'window_end')}, events, edits, approvals, rejections, rate AS edit_rate_pct,
           CASE WHEN rate > 50 THEN 'ALERT' WHEN rate >= 30 THEN 'ABOVE_TARGET' WHEN rate IS NOT NULL THEN 'OK' END AS status FROM r""")
def stream_sliding_monitor(t):
    out = result(t, jobs.sliding_monitor(event_stream(t)), "monitor")
    return out.withColumn("window_start", ts("window_start")).withColumn("window_end", ts("window_end"))


@query("stream_daily_volume", "enc", """
    SELECT strftime(start_at, '%Y-%m-%d') AS day, organization_id, count(*)::BIGINT AS transitions FROM enc
    WHERE encounter_class = 'snf' AND start_at + INTERVAL 1 DAY <= (SELECT max(start_at) - INTERVAL 1 DAY FROM enc WHERE encounter_class = 'snf') GROUP BY ALL""")
def stream_daily_volume(t):
    stays = streamed(t, "orders").filter(F.substring("o_orderpriority", 1, 1) == "3").select(
        F.col("o_orderdate").alias("admission_date"), (F.col("o_custkey") % 10).alias("organization_id")
    )
    return result(t, jobs.daily_volume(stays), "volume").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


CLOCK_ACTIONS = "'ASSIGNED', 'APPROVED', 'REJECTED', 'SENT', 'GENERATED'"
CLOCK_SQL = """{name} AS (SELECT transition_id, '{kind}' AS kind, action, action_at AS started_at, action_at + {hours} * INTERVAL 1 HOUR AS due_at,
      lead(action_at) OVER (PARTITION BY transition_id ORDER BY action_at, log_id) AS nxt FROM evt LEFT JOIN nar USING (transition_id) WHERE action IN ({acts}))"""


@query("stream_review_clocks", "evt nar", "WITH " + CLOCK_SQL.format(
    name="esc", kind="ESCALATE", hours="CASE risk_tier WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 12 ELSE 4 END", acts="'ASSIGNED', 'APPROVED', 'REJECTED'") + ", " + CLOCK_SQL.format(
    name="exp", kind="EXPIRE", hours="72", acts="'APPROVED', 'SENT', 'REJECTED', 'GENERATED'") + f"""
    SELECT transition_id, kind, {sts('started_at')}, {sts('due_at')} FROM (SELECT * FROM esc WHERE action = 'ASSIGNED' UNION ALL SELECT * FROM exp WHERE action = 'APPROVED')
    JOIN (SELECT transition_id, max(action_at) AS seen FROM evt WHERE action IN ({CLOCK_ACTIONS}) GROUP BY 1) USING (transition_id)
    WHERE (nxt IS NULL OR nxt > due_at) AND (due_at < seen OR due_at <=
      (SELECT date_trunc('millisecond', max(action_at)) - INTERVAL 1 DAY FROM evt WHERE action IN ({CLOCK_ACTIONS})))""")
def stream_review_clocks(t):
    """The last clock of a document runs out only if the watermark, or a later event of it, passes its due time."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    out = jobs.standing_alerts(result(t, jobs.review_clocks(event_stream(t), t.narratives), "clocks"))
    return out.select("transition_id", "kind", ts("started_at"), ts("due_at"))


@query("review_clocks", "evt nar", "WITH " + CLOCK_SQL.format(
    name="esc", kind="ESCALATE", hours="CASE risk_tier WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 12 ELSE 4 END", acts="'ASSIGNED', 'APPROVED', 'REJECTED'") + ", " + CLOCK_SQL.format(
    name="exp", kind="EXPIRE", hours="72", acts="'APPROVED', 'SENT', 'REJECTED', 'GENERATED'") + f"""
    SELECT transition_id, kind, {sts('started_at')}, {sts('due_at')} FROM (SELECT * FROM esc WHERE action = 'ASSIGNED' UNION ALL SELECT * FROM exp WHERE action = 'APPROVED')
    WHERE (nxt IS NULL OR nxt > due_at) AND due_at <= TIMESTAMP '2024-01-29'""")
def review_clocks(t):
    until = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    out = jobs.review_clocks_batch(t.review_events, t.narratives, until)
    return out.select("transition_id", "kind", ts("started_at"), ts("due_at"))


@query("stream_invalidations", "evt enc med", f"""
    SELECT a.transition_id, e.kind, {sts('a.action_at', 'approved_at')}, {sts('e.s', 'start_at')} FROM evt a
    JOIN (SELECT patient_id, 'ENCOUNTER' AS kind, start_at + INTERVAL {SHIFT} DAY AS s FROM enc
          UNION ALL SELECT patient_id, 'MEDICATION', start_at + INTERVAL {SHIFT} DAY FROM med) e ON e.patient_id = a.transition_id
     AND e.s > a.action_at AND e.s <= a.action_at + INTERVAL 72 HOUR WHERE a.action = 'APPROVED'""")
def stream_invalidations(t):
    """Two streams of changes: orders as new encounters, and order lines of open orders as new medications."""
    approvals = event_stream(t).filter("action = 'APPROVED'").select(
        "transition_id", F.col("transition_id").alias("patient_id"), F.col("action_at").alias("approved_at")
    )
    encounters = streamed(t, "orders").select(
        F.col("o_custkey").alias("patient_id"), add_days("o_orderdate", F.lit(SHIFT)).alias("start_at")
    )
    # a line names its patient by its order and is a medication by its entry in the catalogue: both tables stand still
    medications = (
        streamed(t, "lineitem").filter("l_linestatus = 'O'")
        .join(t.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.table("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .select(F.col("o_custkey").alias("patient_id"), add_days("l_shipdate", F.lit(SHIFT)).alias("start_at"))
    )
    out = result(t, jobs.invalidations(approvals, {"ENCOUNTER": encounters, "MEDICATION": medications}), "invalidations")
    return out.select("transition_id", "kind", ts("approved_at"), ts("start_at"))


@query("stream_flag_undercoding", "pat proc med cond cat enc", f"""WITH {money_queries.OPT}
    SELECT encounter_id, patient_id, daily_gap, (encounter_id % 3) * 20 > 24 AS late FROM enc JOIN gap USING (patient_id) WHERE daily_gap > 100""")
def stream_flag_undercoding(t):
    """Each order is an assessment, seen 0, 20 or 40 hours later."""
    seen = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 3 * 20).cast("int"))
    assessments = streamed(t, "orders").select(
        F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("assessed_at"), seen.alias("seen_at"),
    )
    out = result(t, jobs.flag_undercoding(assessments, money_queries.gaps(t)), "flags")
    return out.select("encounter_id", "patient_id", "daily_gap", "late")


@query("stream_generate_new", "", """
    SELECT DISTINCT sha256(text) AS prompt_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) || ' words' AS output FROM documents""")
def stream_generate_new(t):
    base = f"{shared_folder(t.spark).rstrip('/')}/generate-{uuid.uuid4().hex}"
    prompts = streamed(t, "documents").select(F.col("text").alias("prompt"))
    jobs.generate_new(prompts, f"{base}/out", f"{base}/checkpoint", narrative_queries.word_counter, "word-counter")
    return t.spark.read.parquet(f"{base}/out").select("prompt_hash", "output")


@query("stream_late_rows", "evt", f"""
    WITH w AS (SELECT date_trunc('millisecond', max(action_at)) - INTERVAL 1 DAY AS mark FROM evt WHERE log_id % 10 <> 0),
    e AS (SELECT CASE WHEN log_id % 10 = 0 THEN 2 ELSE 1 END AS step, log_id % 10 = 0 AND action_at <= mark AS late, mark FROM evt, w)
    SELECT step, count(*) AS input_rows, count_if(late)::BIGINT AS dropped_rows, (count(*) - count_if(late))::BIGINT AS kept_rows,
           CASE step WHEN 1 THEN '1970-01-01T00:00:00.000Z' ELSE strftime(max(mark), '%Y-%m-%dT%H:%M:%S.%gZ') END AS watermark
    FROM e GROUP BY step""")
def stream_late_rows(t):
    """A tenth of the events comes after all others: what lies behind the watermark by then is dropped, and counted."""
    base = f"{shared_folder(t.spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    log = t.review_events.select("log_id", "transition_id", "action", F.col("action_at").cast("timestamp").alias("action_at"))
    for part in (F.col("log_id") % 10 != 0, F.col("log_id") % 10 == 0):
        log.filter(part).write.mode("append").parquet(f"{base}/in")
        events = jobs.distinct_events(jobs.read_stream(t.spark, f"{base}/in", log.schema))
        progress.run_recorded(events, "events", f"{base}/out", f"{base}/checkpoint", f"{base}/progress")
    told = t.spark.read.schema(progress.PROGRESS).parquet(f"{base}/progress").filter("input_rows > 0")
    # one row per batch, here two
    step = F.row_number().over(Window.partitionBy("query").orderBy("batch"))
    kept = t.spark.read.schema(events.schema).parquet(f"{base}/out").groupBy(
        F.when(F.col("log_id") % 10 == 0, 2).otherwise(1).alias("step")
    ).agg(F.count(F.lit(1)).alias("kept_rows"))
    return told.withColumn("step", step).join(kept, "step").select("step", "input_rows", "dropped_rows", "kept_rows", "watermark")
