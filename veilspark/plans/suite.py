"""Registered queries: every operator on the given tables, with SQL twins.

A suite module registers pairs with ``@query(name, sql)``. The SQL is written
independently of the operators (and naively: it may compare all pairs), to
check their results.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_MODULES = ("suite_text", "suite_registry", "suite_corpus", "suite_redaction", "suite_updates", "suite_stream")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["m3_redact"](spark, sf_dir)
