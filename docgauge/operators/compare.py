"""Paired comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.text import normalize
from docgauge.operators.coverage import enforce

#: Differences up to this are ties.
TIE = 1e-12


def verdict(delta: Column) -> Column:
    return F.when(delta > TIE, "improved").when(delta < -TIE, "regressed").otherwise("tied")


def paired(required: DataFrame, base: DataFrame, other: DataFrame, key: str, score: str) -> DataFrame:
    """Score of two runs for everything required; what is missing scores 0."""
    a = base.select(key, F.col(score).alias("base"))
    b = other.select(key, F.col(score).alias("other"))
    both = required.select(key).join(a, key, "left").join(b, key, "left").na.fill(0.0, ["base", "other"])
    return both.withColumn("delta", F.col("other") - F.col("base"))


def paired_conditions(scored: DataFrame, key: Sequence[str], condition: str, names: Sequence[str], score: Column) -> DataFrame:
    """One row per key with a column for each condition: one aggregate in place of self-joins."""
    return scored.groupBy(*key).agg(*[F.max(F.when(F.col(condition) == n, score)).alias(n) for n in names])


def delta_counts(delta: Column) -> list[Column]:
    return [
        F.count_if(delta > TIE).alias("improved"),
        F.count_if(delta < -TIE).alias("regressed"),
        F.count_if(F.abs(delta) <= TIE).alias("tied"),
        F.sum(F.when(delta > TIE, delta).otherwise(F.lit(0.0))).alias("sum_gain"),
        F.sum(F.when(delta < -TIE, delta).otherwise(F.lit(0.0))).alias("sum_loss"),
        F.avg(delta).alias("mean_delta"),
    ]


def agreement(status_a: Column, text_a: Column, status_b: Column, text_b: Column) -> Column:
    """Whether two answers are the same; null unless both are ok: then they can't be compared."""
    both = (status_a == "ok") & (status_b == "ok") & text_a.isNotNull() & text_b.isNotNull()
    return F.when(both, normalize(text_a) == normalize(text_b))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field) wherever two tables differ in a field, null-safe."""
    left = a.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]))
    return left.join(right, key).select(key, F.explode(fields).alias("field"))


def same_rows(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> None:
    """Raises, naming some fields, unless rows of the same key agree in all ``columns``."""
    enforce(mismatches(a, b, key, columns), "rows differ")


def best_step(summary: DataFrame, step: str, score: str) -> DataFrame:
    """The step with the best score; of equals, the earliest."""
    return summary.orderBy(F.desc(score), F.asc(step)).limit(1)
