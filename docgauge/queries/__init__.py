"""Registry of the core queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgauge.queries import comparison, deliveries, evidence, inventory, lifecycle, records, resampling, scoring, selection, statistics

FAMILIES = (scoring, records, comparison, statistics, selection, resampling, deliveries, evidence, inventory, lifecycle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["requested_set_score"](spark, folder)
