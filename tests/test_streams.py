"""Streams over several files, one per micro-batch, against their batch twins."""

import pytest
from pyspark.sql import functions as F

from transitus.sources.binding import Binding
from transitus.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Review events in files of increasing time."""
    path = str(tmp_path_factory.mktemp("events"))
    log = Binding(spark, FOLDER).review_events.select(
        "log_id", "transition_id", "action", F.col("action_at").cast("timestamp").alias("action_at")
    )
    bounds = [r[0] for r in log.selectExpr("percentile_approx(action_at, array(0.3, 0.6)) AS p").select(F.explode("p")).collect()]
    for i, cond in enumerate([F.col("action_at") < bounds[0], F.col("action_at").between(bounds[0], bounds[1]), F.col("action_at") > bounds[1]]):
        log.filter(cond).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream, tmp_path):
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def mark(batch):
    return F.lit(batch.agg(F.max("action_at")).first()[0]) - F.expr("INTERVAL 1 DAY")


def test_sliding_monitor(spark, events, tmp_path):
    stream = jobs.read_stream(spark, events, spark.read.parquet(events).schema, 1)
    got = run(spark, jobs.sliding_monitor(stream), tmp_path).collect()
    batch = spark.read.parquet(events)
    want = jobs.sliding_monitor(batch, late=None).filter(F.col("window_end") <= mark(batch)).collect()
    assert got and sorted(got) == sorted(want)


def test_clocks(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    tiers = Binding(spark, FOLDER).narratives
    stream = jobs.read_stream(spark, events, spark.read.parquet(events).schema, 1)
    got = jobs.standing_alerts(run(spark, jobs.review_clocks(stream, tiers), tmp_path))
    batch = spark.read.parquet(events)
    until = mark(batch)
    want = jobs.review_clocks_batch(batch, tiers, until)
    # alerts due after the watermark appear in the stream only where a later event showed them to be due
    assert sorted(got.filter(F.col("due_at") <= until).collect()) == sorted(want.collect())
    assert got.filter("kind = 'EXPIRE'").count() > 0 and got.filter("kind = 'ESCALATE'").count() > 0


def test_clocks_out_of_order(spark, tmp_path):
    """Files whose events overlap by up to 20 hours, and a late rejection of an earlier hour: the folded changelog is the batch twin's result."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    tiers = Binding(spark, FOLDER).narratives
    log = Binding(spark, FOLDER).review_events.select(
        "log_id", "transition_id", "action", F.col("action_at").cast("timestamp").alias("action_at")
    )
    came = F.col("action_at") + F.make_dt_interval(F.lit(0), F.pmod(F.hash("log_id"), F.lit(20)))
    bounds = [r[0] for r in log.selectExpr("percentile_approx(action_at, array(0.3, 0.6)) AS p").select(F.explode("p")).collect()]
    path = str(tmp_path / "mixed")
    extra = spark.sql(
        "SELECT * FROM VALUES (0, -1L, 'ASSIGNED', 10), (0, -2L, 'ASSIGNED', 10), (1, -1L, 'REJECTED', 5), (1, -2L, 'REJECTED', 11), "
        "(0, -3L, 'ASSIGNED', 10), (0, -3L, 'SENT', 15), (1, -3L, 'REJECTED', 12) AS t(file, doc, action, hour)"
    )
    for i, cond in enumerate([came <= bounds[0], (came > bounds[0]) & (came <= bounds[1]), came > bounds[1]]):
        late = extra.filter(F.col("file") == i).select(
            (-F.col("hour")).cast("bigint").alias("log_id"), F.col("doc").alias("transition_id"), "action",
            (F.lit(bounds[0]) - F.expr("INTERVAL 15 HOURS") + F.make_dt_interval(F.lit(0), F.col("hour"))).alias("action_at"),
        )
        log.filter(cond).unionByName(late).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = jobs.read_stream(spark, path, batch.schema, 1)
    got = run(spark, jobs.review_clocks(stream, tiers), tmp_path)
    until = mark(batch)
    standing = sorted(map(tuple, jobs.standing_alerts(got).collect()))
    # due by the watermark, or shown to be due by a later event
    actions = sorted({a for starts, stops in jobs.CLOCK_EVENTS.values() for a in (*starts, *stops)})
    seen = batch.filter(F.col("action").isin(*actions)).groupBy("transition_id").agg(F.max("action_at").alias("seen"))
    twin = jobs.review_clocks_batch(batch, tiers, F.lit("2100-01-01").cast("timestamp")).join(seen, "transition_id")
    want = twin.filter((F.col("due_at") <= until) | (F.col("due_at") < F.col("seen"))).drop("seen")
    assert standing == sorted(map(tuple, want.collect())) and len(standing) == len(set(standing))
    told = {i: [r["change"] for r in got.filter(F.col("transition_id") == i).collect()] for i in (-1, -2, -3)}
    assert told[-1] == ["ALERT"] and told[-2] == [] and sorted(told[-3]) == ["ALERT", "WITHDRAWN"]


def test_clocks_play():
    """A rejection before the start that stands does not stop it; a later event shows an alert once."""
    hour = jobs.HOUR_US
    idle = dict.fromkeys(jobs.CLOCK_EVENTS)
    events = [(10 * hour, 1, "ASSIGNED", 4), (5 * hour, 2, "REJECTED", 4)]
    clocks, alerts = jobs.play(idle, sorted(events))
    assert clocks["ESCALATE"] == (10 * hour, 14 * hour) and alerts == []
    clocks, alerts = jobs.play(clocks, [(14 * hour, 3, "REJECTED", 4)])
    assert clocks == idle and alerts == []
    clocks, alerts = jobs.play({**idle, "ESCALATE": (10 * hour, 14 * hour)}, [(14 * hour + 1, 3, "APPROVED", 4)])
    assert alerts == [("ESCALATE", 10 * hour, 14 * hour)] and clocks["ESCALATE"] is None and clocks["EXPIRE"]


def test_invalidations(spark, events, tmp_path):
    schema = spark.read.parquet(events).schema

    def sides(df):
        a = df.filter("action = 'APPROVED'").select("transition_id", F.col("transition_id").alias("patient_id"), F.col("action_at").alias("approved_at"))
        c = df.filter("action = 'VIEWED'").select(F.col("transition_id").alias("patient_id"), F.col("action_at").alias("start_at"), "action")
        return a, c

    streams = [jobs.read_stream(spark, events, schema, 1) for _ in range(2)]
    got = run(spark, jobs.invalidations(sides(streams[0])[0], sides(streams[1])[1]), tmp_path)
    want = jobs.invalidations_batch(*sides(spark.read.parquet(events)))
    assert sorted(got.collect()) == sorted(want.collect())


def test_invalidations_of_two_kinds(spark, events, tmp_path):
    """One kind of change has all its rows in the first batch, the other comes in three: none is dropped."""
    schema = spark.read.parquet(events).schema
    ahead = str(tmp_path / "ahead")
    spark.read.parquet(events).filter("action = 'EDITED'").coalesce(1).write.parquet(ahead)

    def sides(df, early):
        a = df.filter("action = 'APPROVED'").select("transition_id", F.col("transition_id").alias("patient_id"), F.col("action_at").alias("approved_at"))
        change = lambda rows: rows.select(F.col("transition_id").alias("patient_id"), F.col("action_at").alias("start_at"))
        return a, {"ENCOUNTER": change(df.filter("action = 'VIEWED'")), "MEDICATION": change(early)}

    stream = lambda path: jobs.read_stream(spark, path, schema, 1)
    got = run(spark, jobs.invalidations(*sides(stream(events), stream(ahead))), tmp_path)
    a, kinds = sides(spark.read.parquet(events), spark.read.parquet(ahead))
    both = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("kind", F.lit(kind))
        both = rows if both is None else both.unionByName(rows)
    want = jobs.invalidations_batch(a, both).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.select("kind").distinct().count() == 2


def test_generation_once(spark, tmp_path):
    src = tmp_path / "in"
    for texts in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "prompt string").coalesce(1).write.mode("append").parquet(str(src))
    for _ in range(2):
        stream = jobs.read_stream(spark, str(src), spark.read.parquet(str(src)).schema, 1)
        jobs.generate_new(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda: (lambda xs: [x.upper() for x in xs]), "m")
    assert sorted(r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]


def test_progress_counts_rows_behind_the_watermark(spark, tmp_path):
    """Three files: the second has late and duplicate events, the third is later than all; counts per batch, over two runs."""
    from transitus.streaming import progress

    schema = "log_id bigint, transition_id bigint, action string, action_at timestamp"
    at = lambda *ids: spark.createDataFrame([(i, i, "EDITED") for i in ids], "log_id bigint, transition_id bigint, action string").withColumn(
        "action_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("log_id") * 3600)
    )
    source, told = str(tmp_path / "in"), str(tmp_path / "progress")
    # ids are hours: after 1 to 100 the watermark stands at hour 76
    for ids in ([*range(1, 101)], [3, 50, 76, 77, 100, 101, 101], [90, 200]):
        at(*ids).write.mode("append").parquet(source)
        stream = jobs.distinct_events(jobs.read_stream(spark, source, schema))
        progress.run_recorded(stream, "events", str(tmp_path / "out"), str(tmp_path / "cp"), told)
    rows = spark.read.parquet(told).filter("input_rows > 0").orderBy("batch").select("query", "input_rows", "dropped_rows").collect()
    assert [tuple(r) for r in rows] == [("events", 100, 0), ("events", 7, 3), ("events", 2, 0)]
    kept = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("log_id").orderBy("log_id").collect()]
    assert kept == [*range(1, 102), 200]
    assert [tuple(r) for r in progress.late_report(spark.read.parquet(told)).collect()] == [("events", 3, 109, 3)]
    again = progress.late_report(spark.read.parquet(told).unionAll(spark.read.parquet(told)))
    assert [tuple(r) for r in again.collect()] == [("events", 3, 109, 3)]


def test_missed_batches_are_an_error():
    from transitus.streaming import progress

    class Query:
        def __init__(self, lots):
            self.lots = lots

        def awaitTermination(self, timeout):
            self.recentProgress = [
                {"batchId": b, "runId": "r", "numInputRows": 1, "stateOperators": [], "eventTime": {}} for b in self.lots.pop(0)
            ]
            return not self.lots

    assert [[r[2] for r in lot] for lot in progress.batches(Query([[4, 5], [], [5, 6, 6]]), "q")] == [[4, 5], [6]]
    with pytest.raises(RuntimeError, match="batches 6 to 7"):
        list(progress.batches(Query([[4, 5], [8]]), "q"))


def test_tables_that_are_folders(spark, tmp_path):
    """A table may be one file or a folder of files: the stream reads either."""
    from transitus.plans import QUERIES

    rows = [(1, "one two", "en"), (2, "three", "en"), (3, "one two", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["stream_generate_new"](spark, str(tmp_path))
    assert sorted(r["output"] for r in got.collect()) == ["1 words", "2 words"]


def test_clocks_ask_the_state_store_little():
    """New events of a document cost one read, one write and one timer, however many states and alerts there are."""
    calls = []

    class Value:
        row = None

        def get(self):
            calls.append("get")
            return self.row

        def update(self, row):
            calls.append("update")
            Value.row = row

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def __getattr__(self, name):
            return lambda at: calls.append((name, at))

    hour = jobs.HOUR_US
    clocks = jobs.Clocks()
    clocks.init(Handle())
    events = [(0, 1, "ASSIGNED", 4), (5 * hour, 2, "APPROVED", 4)]
    told = list(clocks._settle((7,), events, 0))
    assert [(r.kind, r.change) for r in told] == [("ESCALATE", "ALERT")]
    assert calls == ["get", ("registerTimer", 77 * hour // 1000), "update"]
    calls.clear()
    told = list(clocks._settle((7,), [], 77 * hour, 77 * hour // 1000))
    assert [(r.kind, r.change) for r in told] == [("EXPIRE", "ALERT")] and calls == ["get", "update"]


def test_clocks_with_events_of_no_document(spark, tmp_path):
    """Events without a document cost others no alert."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    tiers = Binding(spark, FOLDER).narratives
    log = Binding(spark, FOLDER).review_events.select(
        "log_id", F.when(F.col("log_id") % 11 != 0, F.col("transition_id")).alias("transition_id"), "action",
        F.col("action_at").cast("timestamp").alias("action_at"),
    )
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    got = jobs.standing_alerts(run(spark, jobs.review_clocks(jobs.read_stream(spark, str(tmp_path / "in"), batch.schema), tiers), tmp_path))
    want = jobs.review_clocks_batch(batch, tiers, mark(batch)).filter("transition_id IS NOT NULL").collect()
    assert want and sorted(got.filter(F.col("transition_id").isNotNull() & (F.col("due_at") <= mark(batch))).collect()) == sorted(want)
