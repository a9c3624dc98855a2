"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, ingest_queries, listing_queries, matching_queries, metric_queries, report_queries, sales_queries

_MODULES = [sales_queries, listing_queries, metric_queries, matching_queries, ingest_queries, evidence_queries, report_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
