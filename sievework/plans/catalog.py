"""All queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retrieval", "texts", "evaluation", "registry", "reports", "pipeline")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"sievework.plans.{module}"), name)
        assert not out.keys() & part.keys()
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
