"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import aggregates, filters, generation, joins, pipeline, scans, stages, texts

_MODULES: tuple = (scans, filters, joins, aggregates, texts, stages, generation, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for module in _MODULES:
        out |= module.SQL
    return out
