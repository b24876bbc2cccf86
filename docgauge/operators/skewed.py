"""Joins to one row per key that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key holds more than ``1 / HOT_KEYS`` of all rows, so there are fewer
#: hot keys than this whatever the size of the table: only they are broadcast.
HOT_KEYS = 1000
#: Keys with no more rows than this are never hot: one task can hold them.
HOT_ROWS = 100_000

#: 0 for rows of ordinary keys, 1 to HOT_KEYS for those of hot keys.
SALT = "__salt"
COUNT = "__count"
_HOT = "__hot"


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each non-null key, counted on the map side first."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(COUNT))


def hot_counted(counts: DataFrame, key: str, count: str, total: int, *, hot_rows: int | None = None) -> list:
    """The hot keys among counted ones, of a table of ``total`` rows; never more than ``HOT_KEYS``."""
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, total // HOT_KEYS)
    if total <= limit:
        return []
    return [r[key] for r in counts.where(F.col(count) > limit).select(key).collect()]


def hot_keys(rows: DataFrame, key: str, *, hot_rows: int | None = None) -> list:
    """The hot keys of ``rows``, nearly always none; never more than ``HOT_KEYS``."""
    counts = key_counts(rows, key)
    most, total = counts.agg(F.max(COUNT), F.sum(COUNT)).first()
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return []
    return hot_counted(counts, key, COUNT, total, hot_rows=hot_rows)


def lookup(rows: DataFrame, per_key: DataFrame, key: str, *, spread: list[str], hot: list | None = None, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row per ``key``.

    Rows of hot keys meet a broadcast of at most ``HOT_KEYS`` rows and are
    spread over the partitions by ``spread``; the others are joined by a
    shuffle on the key.  Null keys match nothing.  ``how`` is left or inner.
    ``hot`` are the hot keys, if the caller knows them.  The result keeps the
    column ``__salt``, by which it is partitioned together with the key.
    """
    values = [c for c in per_key.columns if c != key]
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(per_key, key, how).select(*[F.col(f"`{c}`") for c in rows.columns], *values, F.lit(0).alias(SALT))
    listed = rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema)
    ahead = listed.join(per_key, key, "left").select(F.col(key).alias(_HOT), F.struct(*values).alias("__ahead"))
    found = rows.join(F.broadcast(ahead), F.col(key) == F.col(_HOT), "left")
    salt = F.when(F.col(_HOT).isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(HOT_KEYS))).otherwise(F.lit(0))
    found = found.withColumn(SALT, salt.cast("int"))
    behind = per_key.select(key, F.struct(*values).alias("__behind"), F.lit(0).alias(SALT), F.lit(True).alias("__there"))
    found = found.join(behind, [key, SALT], "left")
    found = found.withColumn("__value", F.when(F.col(SALT) == 0, F.col("__behind")).otherwise(F.col("__ahead")))
    if how == "inner":
        matched = listed.join(per_key, key, "left_semi").select(F.col(key).alias("__matched"))
        found = found.join(F.broadcast(matched), F.col(_HOT) == F.col("__matched"), "left")
        found = found.where(F.col("__there") | F.col("__matched").isNotNull())
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__value.{c}").alias(c) for c in values], SALT)
