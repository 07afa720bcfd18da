"""All registered queries of the library, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import audit_queries, context_queries, eval_queries, more_queries, page_queries, search_queries, rollup_queries, signal_queries, source_queries, text_queries

MODULES = (text_queries, signal_queries, eval_queries, rollup_queries, source_queries, more_queries, context_queries, page_queries, search_queries, audit_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical retrieval with reranking."""
    return QUERIES["r14_rerank"](spark, sf_dir)
