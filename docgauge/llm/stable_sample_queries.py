"""Queries on the reproducible sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm.stable_sample import GOLDEN, SHIFT, TURN, stable_sample
from docgauge.session import table

SHARE = 0.1


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample(table(spark, folder, "internvl_error_sample_v1"), "question_id", SHARE)


QUERIES = {"p3_sample": p3_sample}

SQL = {
    "p3_sample": f"""
SELECT question_id, position FROM (
  SELECT DISTINCT question_id, CAST((question_id::HUGEINT * {GOLDEN} % {TURN} + {SHIFT}) % {TURN} AS BIGINT) AS position
  FROM internvl_error_sample_v1 WHERE question_id IS NOT NULL)
WHERE position < {round(SHARE * TURN)}""",
}
