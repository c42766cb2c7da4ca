"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ranking", "defects", "splitting", "conversations", "packing", "mixing", "garble")


def _collect(name: str) -> dict:
    return {key: value for module in MODULES for key, value in getattr(import_module(f"lectern.llm.{module}"), name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
