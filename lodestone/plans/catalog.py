"""Registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import array_queries, graph_queries, ml_queries, store_queries, text_queries, vector_queries

_MODULES = (text_queries, vector_queries, graph_queries, ml_queries, array_queries, store_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
