"""Cluster bootstrap of a paired mean difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.functions.digests import hashed, hashed_index
from docgauge.operators.sampling import running_total
from docgauge.session import cut


#: Draws that one task makes, at most.
TASK_DRAWS = 2_000_000


def cluster_bootstrap(scores: DataFrame, group: str, base: str, other: str, *, replicates: int, seed: int) -> DataFrame:
    """One row: observed mean, mean and 2.5 / 97.5 percentiles of the resampled mean difference.

    Groups are drawn with replacement and keep their multiplicity; a mean
    weighs questions alike.  Groups are reduced to sums first and numbered in
    the order of a hash, so a draw costs one row whatever the size of the
    group.  Draws depend on the seed, the replicate and the draw alone; there
    are replicates times groups of them, made where they are needed from a
    range and shuffled once, never held in an array or broadcast.  A null group
    is a group.
    """
    named = scores.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("?")))
    sums = cut(named.groupBy("__group").agg(F.sum(F.col(other) - F.col(base)).alias("gain"), F.count(F.lit(1)).alias("n")))
    spot = F.sha2(F.substring("__group", 2, 2**31 - 1), 256)
    dense = running_total(sums.withColumn("__h", spot), F.lit(1), F.substring("__h", 1, 3), [F.col("__h"), F.col("__group")], "place", before=True).select("place", "gain", "n")
    size = sums.count()
    spark = scores.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, replicates * size // TASK_DRAWS)
    draws = spark.range(0, replicates * size, 1, tasks).select(F.expr(f"id div {max(1, size)}").alias("replicate"), F.expr(f"id % {max(1, size)}").alias("draw"))
    draws = draws.select("replicate", hashed_index(hashed(seed, F.col("replicate"), F.col("draw")), F.lit(size)).alias("place"))
    means = draws.join(dense.hint("shuffle_hash"), "place").groupBy("replicate").agg((F.sum("gain") / F.sum("n")).alias("mean"))
    observed = sums.agg(F.sum("gain") / F.sum("n")).scalar()
    return means.agg(
        F.max(F.lit(0.0) + observed).alias("observed"), F.avg("mean").alias("mean"),
        F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"),
    )


def attachable(interval: dict, current: dict) -> tuple[bool, str]:
    """Whether a stored interval belongs to the current inputs: both digests must be there and equal."""
    for name in ("scores_digest", "groups_digest"):
        if not interval.get(name):
            return False, f"the interval has no {name}"
        if interval[name] != current.get(name):
            return False, f"{name} differs"
    return True, "attached"
