"""All queries of the graph operators, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

from shardweave.plans import exchange_queries, graph_queries, model_queries, quant_queries, telemetry_queries  # noqa: E402, F401

Query = Callable[[SparkSession, str], DataFrame]
