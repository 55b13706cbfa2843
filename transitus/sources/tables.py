"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv(spark: SparkSession, path: str, ddl: str, **options: str) -> DataFrame:
    """CSV with a header; a row that does not fit keeps its text in `_corrupt_record` and nulls elsewhere."""
    schema = T.StructType.fromDDL(ddl).add(BAD, "string")
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", BAD).options(**options).csv(path)


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BAD).isNull()).drop(BAD)


def bad_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BAD).isNotNull()).select(BAD)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
