"""Writers: whole tables, rows not there yet, and document export."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def replace_table(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """Write the whole table, in folders by the month of a date column if given."""
    if month_of is None:
        df.write.mode("overwrite").parquet(path)
        return
    month = df.withColumn("month", F.date_format(month_of, "yyyy-MM"))
    month.write.mode("overwrite").partitionBy("month").parquet(path)


COMMITS = "batch string, rows bigint"


def _found(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at `path`, or no rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the appends that were committed; what a broken run left behind is not among them."""
    rows = _found(spark, path, StructType([*schema.fields, StructField("batch", StringType())]))
    done = _found(spark, f"{path.rstrip('/')}/_commits", COMMITS).select("batch").distinct()
    return rows.join(done, "batch", "left_semi").select(*[F.col(f"`{c}`") for c in schema.names])


def append_new(df: DataFrame, path: str, keys: list[str]) -> str | None:
    """Append the rows whose keys the table does not hold, so that a rerun adds nothing twice; the new batch, if any.

    Null keys are keys like others. Of rows that repeat a key the one whose other columns come first in order is kept,
    whatever order they come in. The rows are written as a folder of their own, and count for `read_appended` and
    later appends once their batch is listed in the manifest, which is written last. One writer at a time.
    """
    spark, batch = df.sparkSession, uuid.uuid4().hex
    others = [c for c in df.columns if c not in keys]
    payload = F.min(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.count(F.lit(1))
    one = df.groupBy(*[f"`{c}`" for c in keys]).agg(payload.alias("_payload"))
    rows = one.select(*[F.col(f"_payload.`{c}`") if c in others else F.col(f"`{c}`") for c in df.columns])
    present = read_appended(spark, path, df.schema).select(*[F.col(f"`{c}`").alias(f"_has_{k}") for k, c in enumerate(keys)]).distinct()
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"_has_{k}")) for k, c in enumerate(keys)])
    folder = f"{path.rstrip('/')}/batch={batch}"
    rows.join(present, same, "left_anti").write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder).count()
    if not written:
        return None
    spark.createDataFrame([(batch, written)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/_commits")
    return batch


def export_documents(df: DataFrame, path: str, by: str = "facility") -> None:
    """JSON documents in one folder per value of `by`; a large folder gets many files."""
    df.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", 100_000).json(path)
