"""Required sets, the records that answer them, and what is wrong with either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_key(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key: an aggregate, so copies meet on the map side first."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, "__last.*")


def repeated_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unexpected_keys(records: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Distinct keys of records that nothing requires."""
    return records.select(key).where(F.col(key).isNotNull()).distinct().join(required.select(key), key, "left_anti")


def missing_keys(records: DataFrame, required: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(records.select(key), key, "left_anti")


def set_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: keys of the first alone, of the second alone, of both, and whether the sets are equal; null is no key."""
    sides = [df.select(key, F.lit(i).alias("side")).where(F.col(key).isNotNull()) for i, df in enumerate((first, second))]
    per_key = sides[0].unionByName(sides[1]).groupBy(key).agg(F.min("side").alias("low"), F.max("side").alias("high"))
    one = per_key.agg(F.count_if(F.col("high") == 0).alias("only_first"), F.count_if(F.col("low") == 1).alias("only_second"), F.count_if(F.col("low") != F.col("high")).alias("both"))
    return one.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def enforce(violations: DataFrame, message: str) -> None:
    """Raises with a few examples if there is any violation."""
    shown = violations.limit(5).collect()
    if shown:
        raise ValueError(f"{message}: {[r.asDict() for r in shown]}")


def required_set(manifest: DataFrame, key: str, *, size: int | None = None) -> DataFrame:
    """The key column of a manifest, checked to be unique and of the expected size."""
    enforce(repeated_keys(manifest, [key]), "repeated keys in the required set")
    if size is not None and (found := manifest.count()) != size:
        raise ValueError(f"the required set has {found} keys, not {size}")
    return manifest.select(key)


def sidecar_report(required: DataFrame, answers: DataFrame, valid: Column, key: str = "question_id") -> DataFrame:
    """(key, problem) with problem missing, extra, repeated or invalid."""
    per_key = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(valid).alias("valid"))
    both = required.select(key, F.lit(True).alias("wanted")).join(per_key, key, "full_outer")
    problems = F.array(
        F.when(F.col("n").isNull(), "missing"),
        F.when(F.col("wanted").isNull(), "extra"),
        F.when(F.col("n") > 1, "repeated"),
        F.when(F.col("wanted") & ~F.coalesce("valid", F.lit(False)) & F.col("n").isNotNull(), "invalid"),
    )
    return both.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def requested_set_summary(scored: DataFrame, n_requested: Column, by: Sequence[str], *, ok: Column, score: Column, exact: Column, cap: Column | None = None) -> DataFrame:
    """Means over everything requested: failed and missing answers score 0.

    ``scored`` has at most one row per requested key and group.  Counts keep
    ok, failed and missing apart; means over ok rows alone are null without any.
    """
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    counts = scored.groupBy(*by).agg(
        F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_failed"),
        total(score).alias("sum_score"),
        total(exact).alias("sum_exact"),
        F.count_if(ok & (F.coalesce(cap, F.lit(False)) if cap is not None else F.lit(False))).alias("n_cap_hits"),
    )
    n = n_requested
    return counts.select(
        *by, n.alias("n_requested"), "n_ok", "n_failed", (n - F.col("n_ok") - F.col("n_failed")).alias("n_missing"), "n_cap_hits",
        (F.col("sum_score") / n).alias("mean_score"), (F.col("sum_exact") / n).alias("mean_exact"),
        ((n - F.col("n_ok")) / n).alias("failure_rate"), F.try_divide("sum_score", "n_ok").alias("ok_mean_score"),
    )
