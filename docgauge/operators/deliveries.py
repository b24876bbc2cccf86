"""Exactly one copy of each message that was delivered at least once.

Identifiers are split by their aggregated frequency: what came once passes
untouched, only repeated groups are ranked.  A group that holds a large part
of all rows is ranked in salted pieces first, so no task ever sees it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.skewed import COUNT, SALT, hot_counted, key_counts, lookup
from docgauge.session import cut

_TIMES, _RANK = "__times", "__rank"


def _with_frequency(known: DataFrame, key: str, order_by: Sequence[str], how: str) -> DataFrame:
    """Rows with ``__times``, the count of their key, null where it is one.

    Keys are counted once; the repeated ones are written down, and the hot ones
    among them, at most ``HOT_KEYS``, are told by their count.
    """
    repeated = cut(key_counts(known, key).where(F.col(COUNT) > 1).withColumnRenamed(COUNT, _TIMES))
    return lookup(known, repeated, key, spread=list(order_by), hot=hot_counted(repeated, key, _TIMES, known.count()), how=how)


def _ranked(repeated: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Repeated rows with ``__rank`` 1 for the copy to keep."""
    order = [F.col(c).asc_nulls_last() for c in order_by]
    pieces = repeated.withColumn(_RANK, F.row_number().over(Window.partitionBy(key, SALT).orderBy(*order)))
    # one row of an ordinary group, at most HOT_KEYS of a hot one
    ahead = pieces.where(F.col(_RANK) == 1).withColumn(_RANK, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ahead.unionByName(pieces.where(F.col(_RANK) > 1))


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def surplus_deliveries(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """All rows but the first of each ``key`` in the order of ``order_by``.

    Nulls of ``order_by`` come last.  Rows whose key is null carry no identity
    and are never surplus.  Rows equal in key and order are interchangeable:
    exactly one stays.  An empty table gives an empty result.  Other columns
    are passed through; names starting with two underscores are reserved.
    """
    repeated = _with_frequency(df.where(F.col(key).isNotNull()), key, order_by, "inner")
    return _ranked(repeated, key, order_by).where(F.col(_RANK) > 1).select(*_names(df))


def one_per_message(df: DataFrame, key: str, order_by: Sequence[str], *, stored: DataFrame | None = None) -> DataFrame:
    """Exactly one row per ``key``: the first in the order of ``order_by``.

    ``stored`` are rows kept earlier; together with ``df`` they give the new
    store.  Rows with a null key are all kept.  See :func:`surplus_deliveries`
    for nulls, ties and empty tables.
    """
    rows = df if stored is None else stored.unionByName(df, allowMissingColumns=True)
    counted = _with_frequency(rows.where(F.col(key).isNotNull()), key, order_by, "left")
    single = counted.where(F.col(_TIMES).isNull())
    first = _ranked(counted.where(F.col(_TIMES).isNotNull()), key, order_by).where(F.col(_RANK) == 1)
    nameless = rows.where(F.col(key).isNull())
    return single.select(*_names(rows)).unionByName(first.select(*_names(rows))).unionByName(nameless)
