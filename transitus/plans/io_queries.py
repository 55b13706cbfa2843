"""Writers and readers: whole driver tables written, read back and summed up."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from transitus import schemas
from transitus.functions.columns import count_if, n_rows
from transitus.plans.registry import query
from transitus.plans.review_queries import REC
from transitus.session import shared_folder
from transitus.sources import sinks, tables


def place(t, name):
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("table_by_month", "trans", """
    SELECT strftime(admission_date, '%Y-%m') AS month, count(*)::BIGINT AS n, count_if(readmitted)::BIGINT AS readmissions FROM trans GROUP BY 1""")
def table_by_month(t):
    path = place(t, "by-month")
    sinks.replace_table(t.transitions, path, "admission_date")
    stored = t.spark.read.schema("transition_id bigint, readmitted boolean, month string").parquet(path)
    return stored.groupBy("month").agg(n_rows().alias("n"), count_if(F.col("readmitted")).alias("readmissions"))


@query("append_new", "", """
    SELECT source, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1""")
def append_new(t):
    """The English documents first, then all of them: each is stored once."""
    path = place(t, "append")
    docs = t.table("documents").select("doc_id", "source", "text")
    sinks.append_new(t.table("documents").filter("lang = 'en'").select("doc_id", "source", "text"), path, ["doc_id"])
    sinks.append_new(docs, path, ["doc_id"])
    return sinks.read_appended(t.spark, path, docs.schema).groupBy("source").agg(
        n_rows().alias("documents"), F.sum(F.length("text")).cast("bigint").alias("characters")
    )


@query("export_documents", "", "SELECT source AS facility, doc_id, sha256(text) AS text_hash FROM documents")
def export_documents(t):
    path = place(t, "export")
    sinks.export_documents(t.table("documents").select("doc_id", "text", F.col("source").alias("facility")), path)
    stored = t.spark.read.schema("doc_id bigint, text string, facility string").json(path)
    return stored.select("facility", "doc_id", F.sha2("text", 256).alias("text_hash"))


@query("read_csv", "", """
    SELECT CASE WHEN l_returnflag = 'N' THEN 'bad' ELSE 'good' END AS kind, count(*)::BIGINT AS n,
           count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_shipdate END)::BIGINT AS days FROM lineitem GROUP BY 1""")
def read_csv(t):
    """Deficiencies as CSV; open ones carry a word for the survey day, which is no date."""
    path = place(t, "csv")
    day = F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    t.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("facility_id"), F.col("l_partkey").cast("string").alias("f_tag"),
        F.col("l_returnflag").alias("severity"), day.alias("survey_date"), F.col("l_linestatus").alias("scope_severity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("corrected_at"),
    ).write.option("header", True).csv(path)
    rows = tables.read_csv(t.spark, path, schemas.DEFICIENCIES)
    kind = F.when(F.col(tables.BAD).isNull(), "good").otherwise("bad")
    return rows.select(kind.alias("kind"), "*").groupBy("kind").agg(
        n_rows().alias("n"), F.count_distinct(F.when(F.col("kind") == "good", F.col("survey_date"))).cast("bigint").alias("days")
    )


@query("declared_approvals", "evt", f"""{REC}
    SELECT transition_id, status, coalesce(status = 'REJECTED', FALSE) AS regeneration_requested, '2024-01-30' AS created_at FROM state""")
def declared_approvals(t):
    rows = schemas.APPROVALS.rows(t.review_state, datetime(2024, 1, 30))
    return rows.select("transition_id", "status", "regeneration_requested", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
