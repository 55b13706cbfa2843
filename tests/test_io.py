from datetime import datetime

from pyspark.sql import functions as F

from transitus import schemas
from transitus.session import shared_folder, stage
from transitus.sources import sinks, tables

NOW = datetime(2024, 1, 1)


def test_csv_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text("facility_id,f_tag,severity,survey_date,scope_severity,corrected_at\nA,F1,isolated,2024-01-02,D,\nB,F2,pattern,never,E,\n")
    df = tables.read_csv(spark, str(tmp_path / "d.csv"), schemas.DEFICIENCIES)
    assert [r.facility_id for r in tables.good_rows(df).collect()] == ["A"]
    assert [r._corrupt_record for r in tables.bad_rows(df.cache()).collect()] == ["B,F2,pattern,never,E,"]


def test_notes(spark, tmp_path):
    (tmp_path / "n1.txt").write_text("line one\nline two")
    assert tables.read_notes(spark, str(tmp_path)).first().text == "line one\nline two"


def test_append_new_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        sinks.append_new(rows, path, ["id"])
    sinks.append_new(rows.unionAll(spark.createDataFrame([(3, "c")], "id int, v string")), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_append_new_keys_payloads_and_broken_runs(spark, tmp_path):
    """Null keys are appended once, repeated keys keep one row in any order, and an append without its commit is done again."""
    schema = "id int, part string, v string"
    rows = [(1, "a", "x"), (1, None, "y"), (None, None, "z"), (1, "a", "w"), (None, None, "q"), (2, "b", None)]
    want = {(1, "a", "w"), (1, None, "y"), (None, None, "q"), (2, "b", None)}
    for number, told in enumerate((rows, rows[::-1])):
        path = str(tmp_path / f"t{number}")
        frame = spark.createDataFrame(told, schema).repartition(3)
        assert sinks.append_new(frame, path, ["id", "part"]) and sinks.append_new(frame, path, ["id", "part"]) is None
        assert {tuple(r) for r in sinks.read_appended(spark, path, frame.schema).collect()} == want
        assert sinks.read_appended(spark, path, frame.schema).count() == 4
        # a run that broke before its commit
        spark.createDataFrame([(7, "c", "lost")], schema).write.parquet(f"{path}/batch=broken")
        assert sinks.read_appended(spark, path, frame.schema).count() == 4
        sinks.append_new(spark.createDataFrame([(7, "c", "found"), (2, "b", "late")], schema), path, ["id", "part"])
        assert {tuple(r) for r in sinks.read_appended(spark, path, frame.schema).collect()} == want | {(7, "c", "found")}
    assert sinks.append_new(frame.select("id"), str(tmp_path / "ids"), ["id"]) is not None


def test_replace_and_export(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, date'2024-02-03' AS d, 'f1' AS facility UNION ALL SELECT 2, date'2024-03-01', 'f2'")
    sinks.replace_table(rows, str(tmp_path / "m"), "d")
    assert sorted(p.name for p in (tmp_path / "m").glob("month=*")) == ["month=2024-02", "month=2024-03"]
    sinks.replace_table(rows, str(tmp_path / "p"))
    sinks.export_documents(rows, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_declared_table(spark):
    df = schemas.APPROVALS.rows(spark.createDataFrame([(1, None), (2, "SENT")], "transition_id int, status string"), NOW)
    rows = {r.transition_id: r for r in df.collect()}
    assert rows[1].status == "DRAFT" and rows[2].status == "SENT" and rows[1].regeneration_requested is False and rows[1].created_at == NOW
    assert df.schema.simpleString() == schemas.APPROVALS.schema.simpleString()
    long = schemas.NARRATIVES.rows(spark.range(1).select(F.lit("HIGH - several conditions").alias("risk_tier")), NOW)
    assert schemas.NARRATIVES.too_long(long).count() == 1


def test_stage_uses_the_shared_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert stage(spark.range(3), "x").inputFiles()[0].startswith(f"file://{folder}/x-")
