"""Registry of named queries, each with an optional SQL twin for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tracemill.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"duplicate query name {name}")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep
