"""Registered queries: operators applied to the given tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Adds a query; sql may name the views of views.SQL."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = with_views(sql)


def load() -> None:
    from . import chat, dialogue, facts, labels, live, messages, reports, search, sources, traces, trends, upkeep, usage  # noqa: F401
