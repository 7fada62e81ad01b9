"""Query registry: each plan module adds its Spark query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``f(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _load() -> None:
    from factloom.plans import assembly, audits, catalog, decided, discovery, enrichment, evidence, flows, graphs, logs, passes, rules, streams, traces  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
