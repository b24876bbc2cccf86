"""Registry of the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import answer_defect_queries, grouped_split_queries, mixture_queries, packing_queries, page_shape_queries, quantile_queries, stable_sample_queries

FAMILIES = (answer_defect_queries, grouped_split_queries, mixture_queries, packing_queries, page_shape_queries, quantile_queries, stable_sample_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
