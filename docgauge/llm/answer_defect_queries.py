"""Queries on broken question and answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.answer_defects import defective_questions, judged_pairs
from docgauge.session import table

_COLUMNS = ["question_id", "question", "prediction", "reference_answers"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    sent = table(spark, folder, "internvl_error_sample_v1").select(*_COLUMNS, "received_at", "delivery_id")
    return defective_questions(sent, delivered=["received_at", "delivery_id"])


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery with all defect types that fire, comma separated."""
    sent = table(spark, folder, "internvl_error_sample_v1").select(*_COLUMNS, "delivery_id")
    return judged_pairs(sent).selectExpr("delivery_id", "question_id", "array_join(defects, ',') AS defects")


def p1_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that are judged, those without any text, and what must not be: such ones that are not empty, copies judged apart, right answers that are defective."""
    sent = table(spark, folder, "internvl_error_sample_v1").select(*_COLUMNS, "delivery_id")
    rows = judged_pairs(sent)
    blank = F.coalesce(F.regexp_replace("prediction", r"\s", "") == "", F.lit(True))
    right = F.coalesce(F.array_contains("reference_answers", F.col("prediction")) & (F.length(F.trim("prediction")) > 0), F.lit(False)) & ~F.array_contains("defects", "question_copy")
    same = rows.groupBy("question", "prediction", "reference_answers").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.count_if(blank & (F.coalesce(F.try_element_at("defects", F.lit(1)), F.lit("")) != "empty")).alias("blank_missed"), F.count_distinct("defects").alias("verdicts"), F.count_if(right & (F.size("defects") > 0)).alias("right_flagged"))
    return same.agg(F.sum("n").alias("deliveries"), F.sum("blank").alias("blank"), F.sum("blank_missed").alias("blank_missed"), F.count_if(F.col("verdicts") > 1).alias("judged_apart"), F.sum("right_flagged").alias("right_flagged"))


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p1_audit": p1_audit}
SQL = {
    "p1_audit": r"""SELECT count(*) AS deliveries, count_if(coalesce(regexp_replace(prediction, '\s', '', 'g'), '') = '')::BIGINT AS blank, 0::BIGINT AS blank_missed, 0::BIGINT AS judged_apart, 0::BIGINT AS right_flagged FROM internvl_error_sample_v1""",
}
