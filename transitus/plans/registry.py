"""Collects the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transitus.plans.sql import with_
from transitus.session import tune
from transitus.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a function of `Tables`; `needs` names the shared SQL tables used by `sql`."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            ORACLES[name] = with_(needs, sql)
        return fn

    return register
