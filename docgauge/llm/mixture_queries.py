"""Queries on mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.mixture import BLOCK, Share, allot, mixture
from docgauge.llm.tokens import token_counts
from docgauge.session import cut, table


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, list[Share]]:
    targets = [tuple(r) for r in table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").orderBy("source").collect()]
    listed = table(spark, folder, "documents").where(F.col("source").isin([t[0] for t in targets]))
    sizes = cut(token_counts(listed.select("doc_id", "source", "text"), "text"))
    tokens = {r["source"]: r["tokens"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    return sizes, allot(targets, tokens)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sizes, shares = _plan(spark, folder)
    return mixture(sizes, shares)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source the target, what it has, may give, was planned to give and gave, and how often it was gone through.

    ``short`` tells sources whose repeats do not reach their target; what they
    lack is spread over the others, whose shares are then above their targets.
    """
    sizes, shares = _plan(spark, folder)
    whole = sum(s.tokens for s in shares)
    planned = spark.createDataFrame(
        [(s.source, s.target, s.max_repeats, s.tokens, s.tokens * max(0, s.max_repeats), s.planned, s.tokens * max(0, s.max_repeats) < s.target * whole) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens long, most_tokens long, planned_tokens long, short boolean",
    )
    reached = cut(mixture(sizes, shares).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = reached.agg(F.sum("tokens")).first()[0] or 1
    tokens = F.coalesce("tokens", F.lit(0))
    # one row a source on either side
    return planned.join(F.broadcast(reached), "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "most_tokens", "planned_tokens", "short", tokens.alias("tokens"),
        F.coalesce(F.try_divide(tokens, "available_tokens"), F.lit(0.0)).alias("repeats"), (tokens / F.lit(total)).alias("reached_share"),
    )


def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture by characters, which SQL can count: of each source what it has, and whether it gave as planned.

    ``off`` is what a source gave beside its plan; ``beyond`` counts documents
    that were used more often than allowed; ``capped`` tells sources that gave
    all their repeats allow, ``below`` those that gave less than their target
    by more than a block though they could have given it.
    """
    targets = [tuple(r) for r in table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").orderBy("source").collect()]
    sizes = table(spark, folder, "documents").where(F.col("source").isin([t[0] for t in targets])).select("doc_id", "source", F.length("text").cast("long").alias("tokens"))
    have = {r["source"]: r["tokens"] or 0 for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = allot(targets, have)
    made = cut(mixture(sizes, shares))
    used = made.groupBy("source", "doc_id").agg(F.sum("tokens").alias("used")).join(sizes, ["source", "doc_id"]).withColumn("times", F.col("used") / F.col("tokens"))
    whole, wanted = sum(have.values()), {s: t for s, t, _ in targets}
    plan = spark.createDataFrame(
        [(s.source, s.tokens, s.planned, s.max_repeats, s.planned == s.tokens * s.max_repeats, s.planned < min(wanted[s.source] * whole, s.tokens * s.max_repeats) - BLOCK) for s in shares],
        "source string, available long, planned long, most int, capped boolean, below boolean",
    )
    given = used.groupBy("source").agg(F.sum("used").alias("given"), F.max("times").alias("times"))
    return plan.join(F.broadcast(given), "source", "left").select(  # one row a source
        "source", "available", "capped", "below", (F.coalesce("given", F.lit(0)) - F.col("planned")).alias("off"), (F.coalesce("times", F.lit(0.0)) > F.col("most")).alias("beyond"),
    )


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_audit": p7_audit}
# What is capped: targets that a source's repeats do not reach, once what other such sources lack is spread over it.
SQL = {
    "p7_audit": """
WITH RECURSIVE t AS (SELECT m.source, greatest(coalesce(target_share, 0), 0) AS w, greatest(coalesce(max_repeats, 0), 0) AS r, coalesce(sum(length(text)), 0)::BIGINT AS have
  FROM mix_targets m LEFT JOIN documents d ON d.source = m.source GROUP BY ALL),
rounds(k, source, short, unit) AS (
  SELECT 0, source, w = 0 OR have * r = 0, 0.0::DOUBLE FROM t
  UNION ALL
  SELECT k + 1, source, short OR have * r <= w * u, u FROM (
    SELECT k, source, short, w, have, r, (sum(have) OVER () - coalesce(sum(have * r) FILTER (short) OVER (), 0)) / nullif(sum(w) FILTER (NOT short) OVER (), 0) AS u
    FROM rounds JOIN t USING (source)) WHERE k < 20)
SELECT source, have AS available, short AS capped, false AS below, 0::BIGINT AS off, false AS beyond FROM t JOIN rounds USING (source) WHERE k = 20""",
}
