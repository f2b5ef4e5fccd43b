"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relevspark.plans import collection_queries, pipeline_queries, retrieval_queries
from relevspark.plans.tables import Tables


def _on_folder(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(Tables(spark, d))

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    both = collection_queries.QUERIES | retrieval_queries.QUERIES | pipeline_queries.QUERIES
    return {name: _on_folder(f) for name, f in both.items()}


def oracle_sql() -> dict[str, str]:
    return collection_queries.SQL | retrieval_queries.SQL | pipeline_queries.SQL


def entry(spark: SparkSession, d: str) -> DataFrame:
    """BM25 ranking of the documents for every query."""
    return retrieval_queries.bm25_lucene_top100(Tables(spark, d))
