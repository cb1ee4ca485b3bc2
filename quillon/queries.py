"""The registered queries outside the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calibration_queries, change_queries, contract_queries, cost_queries, history_queries, landing_queries, live_queries, score_queries, suspicion_queries, text_queries

PARTS = (cost_queries, change_queries, score_queries, text_queries, landing_queries, live_queries, history_queries, calibration_queries, contract_queries, suspicion_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
