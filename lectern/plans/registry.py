"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import integrity, knowledge, operations, outlines, passages, publication, searching, structures

MODULES = (searching, passages, knowledge, integrity, operations, outlines, publication, structures)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.hybrid_rerank(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
