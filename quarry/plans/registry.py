"""Collects the named queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import catalogue, event_log, matching, outcomes, rules, services, titles

_MODULES = (outcomes, event_log, catalogue, titles, matching, services, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in _MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
