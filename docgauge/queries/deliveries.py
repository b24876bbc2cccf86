"""Queries on messages that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.operators.deliveries import one_per_message, surplus_deliveries
from docgauge.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    sent = table(spark, folder, "internvl_error_sample_v1").select("question_id", "received_at", "delivery_id")
    return surplus_deliveries(sent, "question_id", ["received_at", "delivery_id"]).select("delivery_id")


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    sent = table(spark, folder, "internvl_error_sample_v1").select("question_id", "received_at", "delivery_id", "batch_id", "prediction")
    return one_per_message(sent, "question_id", ["received_at", "delivery_id"])


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept}

_RANKED = """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY received_at NULLS LAST, delivery_id) AS place
FROM internvl_error_sample_v1"""
SQL = {
    "p4_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE place > 1 AND question_id IS NOT NULL",
    "p4_kept": f"SELECT question_id, received_at, delivery_id, batch_id, prediction FROM ({_RANKED}) WHERE place = 1 OR question_id IS NULL",
}
