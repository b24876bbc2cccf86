"""What must not be shared between splits, and which rows are excluded for it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_key(ucsf: Column, doc_id: Column, page: Column, image: Column) -> Column:
    """struct(kind, k1, k2, k3): the document, or the page where it is unknown."""
    missing = F.lit(None).cast("string")
    known = F.struct(F.lit("UCSF").alias("kind"), ucsf.alias("k1"), missing.alias("k2"), missing.alias("k3"))
    page_only = F.struct(F.lit("PAGE_FALLBACK").alias("kind"), doc_id.cast("string").alias("k1"), page.alias("k2"), image.alias("k3"))
    return F.when(ucsf.isNotNull(), known).otherwise(page_only)


def exclusion_reasons(rows: DataFrame, rules: Mapping[str, tuple[str, DataFrame] | Column]) -> DataFrame:
    """``rows`` with ``reason``: the first rule that excludes them, or null.

    A rule is a condition, or a key column with a table of blocked keys.
    Null keys are never blocked.  Each blocklist is joined once, distinct.
    """
    reason = F.lit(None).cast("string")
    marked = rows
    checks: list[tuple[str, Column]] = []
    for name, rule in rules.items():
        if isinstance(rule, tuple):
            key, blocked = rule
            listed = blocked.select(F.col(blocked.columns[0]).alias(f"__{name}")).where(F.col(f"__{name}").isNotNull()).distinct()
            marked = marked.join(listed, F.col(key) == F.col(f"__{name}"), "left")
            checks.append((name, F.col(f"__{name}").isNotNull()))
        else:
            checks.append((name, rule))
    for name, check in reversed(checks):
        reason = F.when(check, F.lit(name)).otherwise(reason)
    return marked.withColumn("reason", reason).drop(*[f"__{n}" for n in rules])


def overlap_counts(a: DataFrame, b: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """(signal, shared): distinct non-null values of each signal that occur on both sides."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), c.cast("string").alias("value")) for k, c in signals.items()])).alias("x")
    long_ = lambda df, side: df.select(stacked, F.lit(side).alias("side")).select("x.*", "side")
    both = long_(a, 1).unionByName(long_(b, 2)).where(F.col("value").isNotNull())
    sides = both.groupBy("signal", "value").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return sides.groupBy("signal").agg(F.count_if(F.col("low") != F.col("high")).alias("shared"))


def blocked_groups(rows: DataFrame, group: str, blocked: Column) -> DataFrame:
    """Groups none of whose members is blocked, with their size."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_or(blocked).alias("blocked")).where(~F.col("blocked")).drop("blocked")
