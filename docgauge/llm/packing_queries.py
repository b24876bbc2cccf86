"""Queries on packing documents into context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.packing import cost_of, pack_items
from docgauge.llm.tokens import token_counts
from docgauge.session import cut, table


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    windows = [(r["window_name"], r["capacity_tokens"]) for r in table(spark, folder, "context_windows").orderBy("window_name").collect()]
    sizes = cut(token_counts(table(spark, folder, "documents").select("doc_id", "text"), "text"))
    return pack_items(sizes, "doc_id", "tokens", windows)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each window, the part of their room that is used, and how their costs spread.

    ``even_cost`` is the cost of a container if all cost the same; no packing's
    dearest container can be cheaper.  A container that one item fills costs
    more than any mixture, so ``dearest_mixed`` is that of the others.
    """
    windows = table(spark, folder, "context_windows")
    filled = p6_packed(spark, folder).groupBy("window_name", "shard", "container").agg(F.sum("tokens").alias("tokens"), F.sum(cost_of(F.col("tokens"))).alias("cost"), F.count(F.lit(1)).alias("items"))
    totals = filled.groupBy("window_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.avg("cost").alias("even_cost"), F.max("cost").alias("dearest"),
        F.max(F.when(F.col("items") > 1, F.col("cost"))).alias("dearest_mixed"), F.stddev_pop("cost").alias("cost_deviation"),
    )
    used = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return totals.join(windows, "window_name").withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("used", used)


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Packing by characters, which SQL can count: what is packed, containers too full, items lost or divided without need."""
    windows = table(spark, folder, "context_windows")
    listed = [(r["window_name"], r["capacity_tokens"]) for r in windows.orderBy("window_name").collect()]
    sizes = table(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("size"))
    packed = cut(pack_items(sizes, "doc_id", "size", listed)).join(windows, "window_name")
    items = packed.groupBy("window_name", "doc_id").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.max("capacity_tokens").alias("capacity"), F.max(F.col("token_from") + F.col("tokens")).alias("end"))
    items = items.join(sizes, "doc_id")
    whole = items.groupBy("window_name").agg(
        F.count(F.lit(1)).alias("items"), F.sum("held").alias("size"), F.count_if((F.col("held") != F.col("size")) | (F.col("end") != F.col("size"))).alias("lost"),
        F.count_if(F.col("pieces") != F.ceil(F.col("size") / F.col("capacity"))).alias("wrongly_divided"),
    )
    filled = packed.groupBy("window_name", "shard", "container").agg(F.sum("tokens").alias("held"), F.max("capacity_tokens").alias("capacity"))
    return whole.join(filled.groupBy("window_name").agg(F.count_if(F.col("held") > F.col("capacity")).alias("too_full")), "window_name")


QUERIES = {"p6_packed": p6_packed, "p6_fill": p6_fill, "p6_audit": p6_audit}
SQL = {
    "p6_audit": """SELECT window_name, count(*) AS items, sum(length(text))::BIGINT AS size, 0::BIGINT AS lost, 0::BIGINT AS wrongly_divided, 0::BIGINT AS too_full
FROM documents, context_windows WHERE length(text) > 0 GROUP BY 1""",
}
