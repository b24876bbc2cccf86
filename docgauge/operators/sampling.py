"""Deterministic sampling in the order of seeded digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.digests import hashed
from docgauge.operators.numbering import numbered


def running_total(rows: DataFrame, value: Column, bucket: Column, order: Sequence[Column], name: str, *, before: bool = False) -> DataFrame:
    """``rows`` with the running sum of ``value`` in a global order.

    ``bucket`` must rise with ``order`` and take a few thousand values at most,
    such as the first digits of a hash.  Sums run inside buckets, and offsets
    over the buckets' totals, so no task sees all rows.
    """
    marked = rows.withColumn("__b", bucket).withColumn("__v", value)
    totals = marked.groupBy("__b").agg(F.sum("__v").alias("__t"))
    # one row per bucket
    offsets = totals.select("__b", (F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("__s", F.sum("__v").over(inside)).join(offsets, "__b")
    total = F.col("__o") + F.col("__s")
    return summed.withColumn(name, total - F.col("__v") if before else total).drop("__b", "__v", "__s", "__o")


def take_groups(groups: DataFrame, key: str, size: str, target: Column, seed: int) -> DataFrame:
    """Whole groups in shuffled order while the total before them is below ``target``."""
    shuffled = groups.withColumn("__h", hashed(seed, F.col(key)))
    summed = running_total(shuffled, F.col(size), F.substring("__h", 1, 3), [F.col("__h"), F.col(key)], "before", before=True)
    return summed.where(F.col("before") < target).drop("__h")


def take_per_group(rows: DataFrame, group: str, key: str, count: int, seed: int) -> DataFrame:
    """At most ``count`` rows of each group, by digest; groups are limited before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hashed(seed, F.col(key)), key))
    return rows.withColumn("__place", place).where(F.col("__place") <= count).drop("__place")


def spread_evenly(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` rows at evenly spaced places in the order of ``key``."""
    indexed = numbered(rows, [], [key])
    n = rows.agg(F.count(F.lit(1))).scalar()
    slots = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    places = rows.sparkSession.range(1).select(slots.alias("slot")).select(F.rint(F.col("slot") * (n - 1) / F.lit(float(max(1, count - 1)))).cast("long").alias("__place"), "slot")
    return indexed.join(F.broadcast(places), "__place").drop("__place")  # as many rows as asked for


def presented(rows: DataFrame, key: str, rounds: float) -> DataFrame:
    """(step, key): the keys in order, over and over, for so many ``rounds``; a broken round ends early."""
    indexed = numbered(rows.select(key), [], [key])
    n = rows.count()
    steps = int(n * rounds)
    cycle = F.sequence(F.col("__place"), F.lit(steps - 1).cast("long"), F.lit(n).cast("long"))
    return indexed.where(F.col("__place") < steps).select(F.explode(cycle).alias("step"), key)


def fill_categories(rows: DataFrame, by: str, key: str, first: Mapping[str, Column], drawn: Mapping[str, Column], ranked: Mapping[str, Column], count: int, seed: int) -> DataFrame:
    """(by, key, category, place): ``count`` rows of each ``by`` from ranked categories, none twice.

    Of each category of ``first`` the smallest key is taken, of each of
    ``drawn`` one by a seeded digest; what is missing is filled, in the order
    of keys, from the categories of ``ranked``, then from all rows as ``fill``.
    """
    picks = [F.min(F.when(c, F.col(key))).alias(f"__{k}") for k, c in first.items()]
    picks += [F.min(F.when(c, F.struct(hashed(seed, F.col(key)).alias("h"), F.col(key).alias("k"))))["k"].alias(f"__{k}") for k, c in drawn.items()]
    marked = rows.join(rows.groupBy(by).agg(*picks), by)
    names = [*first, *drawn, *ranked, "fill"]
    checks = [F.col(key) == F.col(f"__{k}") for k in (*first, *drawn)] + list(ranked.values())
    rank = F.lit(len(names) - 1)
    for i, check in reversed(list(enumerate(checks))):
        rank = F.when(check, i).otherwise(rank)
    placed = marked.select(by, key, rank.alias("__rank")).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__rank", key))).where(F.col("place") <= count)
    return placed.select(by, key, F.element_at(F.array(*map(F.lit, names)), F.col("__rank") + 1).alias("category"), "place")


def size_picks(rows: DataFrame, by: str, key: str, size: str, forced: DataFrame) -> DataFrame:
    """(by, key, pick): the row of middle and of largest ``size`` of each ``by``, then those of ``forced``; none twice.

    The middle of n rows is place ``n div 2``, counted from 0; ties go by key.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    placed = numbered(rows.select(by, key, size), [by], [size, key]).alias("r").join(counts.alias("c"), F.col(f"r.{by}").eqNullSafe(F.col(f"c.{by}")))
    pick = F.when(F.col("__place") == F.expr("__n div 2"), 1).when(F.col("__place") == F.col("__n") - 1, 2)
    picked = placed.select(F.col(f"r.{by}").alias(by), key, pick.alias("pick")).where(F.col("pick").isNotNull())
    return picked.unionByName(forced.select(by, key, F.lit(3).alias("pick"))).groupBy(by, key).agg(F.min("pick").alias("pick"))


def cut_rows(rows: DataFrame, order: Sequence[str], target: int, buffer: int, rejected: Column) -> DataFrame:
    """The first ``target`` rows that are not rejected, among the first ``target + buffer``."""
    near = numbered(rows.withColumn("__rejected", rejected), [], order).where(F.col("__place") < target + buffer)
    kept = near.where(~F.coalesce("__rejected", F.lit(False))).drop("__place", "__rejected")
    return numbered(kept, [], order, "place").where(F.col("place") < target)
