"""Small column expressions with one fixed meaning across all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def total(c: Column | str) -> Column:
    """Sum of money: exact in decimal, a double at the edge, so that row order cannot matter."""
    return F.sum(c).cast("double")


def mean(c: Column | str) -> Column:
    """Average as exact sum over count; null for no values."""
    return ratio(F.sum(c), F.count(c))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pct(a: Column, b: Column) -> Column:
    return a.cast("double") * F.lit(100.0) / F.nullif(b.cast("double"), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def n_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def age_years(birth: Column, as_of: Column, exact: bool = False) -> Column:
    """Year boundaries crossed since birth, or completed years with `exact`."""
    if exact:
        return F.floor(F.months_between(as_of, birth) / 12).cast("bigint")
    return (F.year(as_of) - F.year(birth)).cast("bigint")


def days(end: Column | str, start: Column | str) -> Column:
    """Calendar days from start to end."""
    return F.datediff(end, start).cast("bigint")


def hours(end: Column, start: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end).cast("double") / F.lit(3600.0)


def lookup(value: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """Fixed small mapping as a chain of literal tests."""
    out = None
    for key, result in table.items():
        result = F.lit(result)
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out.otherwise(default) if default is not None else out


RULE_ROWS = 10_000


def rules(spark: SparkSession, rows: Iterable[tuple] | DataFrame, schema: str) -> DataFrame:
    """Rule table from literals, marked for broadcast up to `RULE_ROWS` rows; a longer list, or a table, is joined as it is."""
    if isinstance(rows, DataFrame):
        return rows.select(*[field.split()[0] for field in schema.split(", ")])
    rows = list(rows)
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= RULE_ROWS else table
