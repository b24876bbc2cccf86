"""Queries on keyword-stuffed and link-list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.page_shapes import stuffed_pages
from docgauge.session import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents"), "doc_id", "text")


def p8_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, different texts, copies that are judged apart, and pages of fewer than six words that are flagged."""
    pages = table(spark, folder, "documents").select("doc_id", "text")
    found = stuffed_pages(pages, "doc_id", "text").select("doc_id", F.lit(1).alias("found")).distinct()
    judged = pages.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    texts = judged.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("found").alias("verdicts"), F.count_if((F.col("found") == 1) & (F.size(F.split(F.trim("text"), r"\s+")) < 6)).alias("short"))
    return texts.agg(F.sum("n").alias("pages"), F.count("digest").alias("texts"), F.count_if(F.col("verdicts") > 1).alias("judged_apart"), F.sum("short").alias("short_flagged"))


QUERIES = {"p8_found": p8_found, "p8_audit": p8_audit}
SQL = {
    "p8_audit": "SELECT count(*) AS pages, count(DISTINCT sha256(text)) AS texts, 0::BIGINT AS judged_apart, 0::BIGINT AS short_flagged FROM documents",
}
