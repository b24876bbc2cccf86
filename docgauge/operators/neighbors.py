"""The nearest donor of each query by a number, under exclusions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.operators.numbering import numbered
from docgauge.session import cut, discard

#: Donors in a bucket.
WIDTH = 64


def nearest_donors(rows: DataFrame, key: str, value: str, exclude: list[str], *, width: int = WIDTH) -> DataFrame:
    """(key, donor, distance): the row of nearest ``value`` that differs in ``exclude``; ties to the smallest key.

    Rows that agree in value and all of ``exclude`` are alike, as queries and
    as donors: they are reduced to the smallest key first.  Donors are numbered
    in the order of their value and cut into buckets of ``width``, so a bucket
    holds as many however dense the values lie, and each query is held against
    a few buckets around its own.  A query is settled, exactly, once its best
    donor is nearer than the next value in buckets not yet visited; the others
    look four times as far.  A null in ``exclude`` never excludes.  Rows with a
    null value take no part; queries without any allowed donor get a null one.
    """
    usable = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(exclude)])
    kinds = [f"e{i}" for i in range(len(exclude))]
    alike = usable.groupBy("v", *kinds).agg(F.min("__key").alias("donor"))
    donors = cut(numbered(alike, [], ["v"], "at").withColumn("home", F.expr(f"at div {width}")))
    edges = cut(donors.groupBy("home").agg(F.min("v").alias("low"), F.max("v").alias("high")))
    others = donors.select(F.col("home").alias("place"), F.col("v").alias("w"), "donor", *[F.col(c).alias(f"d_{c}") for c in kinds])
    gap = F.abs(F.col("v") - F.col("w"))
    allowed = reduce(and_, [F.coalesce(F.col(c) != F.col(f"d_{c}"), F.lit(True)) for c in kinds], F.lit(True))
    waiting, reach, settled = donors.select("at", "home", "v", *kinds), 1, []
    buckets = edges.count()
    while buckets:
        near = waiting.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(0), F.col("home") - reach), F.least(F.lit(buckets - 1), F.col("home") + reach))))
        found = near.join(others, "place").where(allowed).groupBy("at").agg(F.min(F.struct(gap.alias("distance"), F.col("donor"))).alias("best"))
        below = edges.select((F.col("home") + reach + 1).alias("home"), F.col("high").alias("below"))
        above = edges.select((F.col("home") - reach - 1).alias("home"), F.col("low").alias("above"))
        looked = waiting.join(found, "at", "left").join(below, "home", "left").join(above, "home", "left")
        rest = F.least(F.col("v") - F.col("below"), F.col("above") - F.col("v"))  # null where all is seen
        looked = cut(looked.withColumn("done", rest.isNull() | F.coalesce(F.col("best.distance") < rest, F.lit(False))))
        settled.append(looked.where("done").select("at", "best"))
        more = looked.where("NOT done").select("at", "home", "v", *kinds)
        if more.isEmpty():
            break
        waiting, reach = more, reach * 4
    discard(edges)
    if not settled:
        return rows.select(key, F.lit(None).cast(rows.schema[key].dataType).alias("donor"), F.lit(None).cast("double").alias("distance")).limit(0)
    best = reduce(DataFrame.unionByName, settled).join(donors.select("at", "v", *kinds), "at")
    same = [F.col("u.v") == F.col("b.v"), *[F.col(f"u.{c}").eqNullSafe(F.col(f"b.{c}")) for c in kinds]]
    return usable.alias("u").join(best.alias("b"), same).select(F.col("u.__key").alias(key), F.col("b.best.donor").alias("donor"), F.col("b.best.distance").alias("distance"))
