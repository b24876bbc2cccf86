"""Digests of whole sequences and sets, in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.operators.numbering import numbered

#: Rows whose values are put together at a time.
CHUNK = 1024


def _chunked(rows: DataFrame, by: list[str], value: Column, order: Column, distinct: bool) -> DataFrame:
    level = rows.select(*by, order.cast("long").alias("__o"), value.cast("string").alias("__v")).where(F.col("__o").isNotNull())
    if distinct:
        level = level.distinct()
    level = numbered(level, by, ["__o", "__v"]).withColumn("__c", F.expr(f"__place div {CHUNK}"))
    pairs = F.array_sort(F.collect_list(F.struct("__place", "__v")))
    chunks = level.groupBy(*by, "__c").agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["__v"]), ","), 256).alias("__d"))
    tops = chunks.withColumn("__t", F.expr(f"__c div {CHUNK}"))
    ordered = F.array_sort(F.collect_list(F.struct("__c", "__d")))
    tops = tops.groupBy(*by, "__t").agg(F.sha2(F.array_join(F.transform(ordered, lambda p: p["__d"]), ","), 256).alias("__d"))
    last = F.array_sort(F.collect_list(F.struct("__t", "__d")))  # a digest for a million rows
    return tops.groupBy(*by).agg(F.sha2(F.array_join(F.transform(last, lambda p: p["__d"]), ","), 256).alias("digest"))


def sequence_digest(rows: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """(by, digest) of the values in the order of an integer.

    A digest of digests of digests: rows are numbered densely and put together
    in chunks of ``CHUNK``, then the chunks, then those, so no task joins a
    whole group.  Rows without a place are left out.
    """
    return _chunked(rows, by, value, order, False)


def set_digest(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, digest) of the distinct values of an integer, whatever their order."""
    return _chunked(rows, by, value, value, True)
