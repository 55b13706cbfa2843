"""Registered queries: operators bound to tables, each with its DuckDB counterpart where SQL can say it."""

from transitus.plans import cohort_queries, io_queries, model_queries, money_queries, narrative_queries, review_queries, stream_queries  # noqa: F401
from transitus.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
