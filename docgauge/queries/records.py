"""Queries on the append log: last records, coverage, guards, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators.coverage import missing_keys, repeated_keys, unexpected_keys
from docgauge.operators.resume import incoherent_runs
from docgauge.queries.scoring import LAST_SQL, RUN, last_records
from docgauge.session import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "holdout_predictions")


def last_record_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return last_records(spark, folder, ["status", "prediction"]).select(*RUN, "question_id", "record_id", "status", "prediction")


def repeated_records(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_keys(_log(spark, folder), ["record_id"])


def unexpected_questions(spark: SparkSession, folder: str) -> DataFrame:
    return unexpected_keys(_log(spark, folder), table(spark, folder, "manifest_examples"), "question_id")


def missing_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Required questions that the last run has no ok record of, whatever the system."""
    log = _log(spark, folder).select("run_tag", "question_id", "status")
    last = log.join(F.broadcast(log.agg(F.max("run_tag").alias("run_tag"))), "run_tag")  # one row
    return missing_keys(last.where(F.col("status") == "ok"), table(spark, folder, "manifest_examples"), "question_id")


def status_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Records by status and run, with those that the manifest does not know."""
    known = table(spark, folder, "manifest_examples").select("question_id", F.lit(True).alias("known")).distinct()
    rows = _log(spark, folder).select(*RUN, "status", "question_id").join(known, "question_id", "left")
    return rows.groupBy(*RUN, "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("unknown"))


def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of a run without an ok record under the run's fingerprint."""
    log = _log(spark, folder).select(*RUN, "question_id", "status", "run_fingerprint_sha256")
    expected = log.groupBy(*RUN).agg(F.max("run_fingerprint_sha256").alias("expected"))
    rows = log.join(expected, RUN).groupBy(*RUN, "question_id").agg(F.bool_or((F.col("status") == "ok") & (F.col("run_fingerprint_sha256") == F.col("expected"))).alias("done"))
    return rows.where(~F.coalesce("done", F.lit(False))).select(*RUN, "question_id")


def fingerprint_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Days of a system that mix fingerprints."""
    return incoherent_runs(_log(spark, folder), ["system", "eval_day"], "run_fingerprint_sha256")


def mixed_hardware(spark: SparkSession, folder: str) -> DataFrame:
    published = table(spark, folder, "holdout_final_analysis")
    return published.groupBy(*RUN).agg(
        F.count_distinct("gpu_name").alias("gpus"), (F.count_distinct("gpu_name") > 1).alias("mixed"),
        F.round(F.max(F.coalesce("peak_allocated_bytes", F.lit(0))) / F.lit(float(1024**3)), 6).alias("peak_gib"),
    )


def cap_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Cap hits; where no flag is there, those inferred from the length."""
    inferred = F.col("generated_token_length") >= F.coalesce("max_new_tokens", F.lit(64))
    rows = _log(spark, folder).groupBy(*RUN, "eval_day").agg(
        F.count("generation_cap_reached").alias("flags"), F.count_if("generation_cap_reached").alias("hits"), F.count_if(inferred).alias("inferred"),
    )
    return rows.select(*RUN, "eval_day", "flags", F.when(F.col("flags") > 0, F.col("hits")).alias("hits"), "inferred")


def long_outputs(spark: SparkSession, folder: str) -> DataFrame:
    long_ = (F.length("prediction") >= 80) | (F.col("generated_token_length") >= 40)
    rows = _log(spark, folder).where(long_).select("record_id", "generated_token_length", F.length("prediction").cast("long").alias("chars")).distinct()
    return rows.orderBy(F.desc("generated_token_length"), F.desc("chars"), "record_id").limit(6)


def field_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Fields in which a delivered record differs from its manifest row."""
    fields = ["doc_id", "ucsf_document_id", "ucsf_document_page_no", "question", "image_relpath"]
    sent = table(spark, folder, "internvl_error_sample_v1").select("delivery_id", "question_id", *[F.col(c).cast("string").alias(f"a_{c}") for c in fields])
    manifest = table(spark, folder, "manifest_examples").select("question_id", *[F.col(c).cast("string").alias(f"b_{c}") for c in fields])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields]))
    return sent.join(manifest, "question_id").select(F.explode(differing).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "last_record_per_key": last_record_per_key, "repeated_records": repeated_records, "unexpected_questions": unexpected_questions,
    "missing_questions": missing_questions, "status_coverage": status_coverage, "resume_pending": resume_pending,
    "fingerprint_coherence": fingerprint_coherence, "mixed_hardware": mixed_hardware, "cap_flags": cap_flags,
    "long_outputs": long_outputs, "field_mismatches": field_mismatches,
}

_FIELDS = ["doc_id", "ucsf_document_id", "ucsf_document_page_no", "question", "image_relpath"]
SQL = {
    "last_record_per_key": f"WITH {LAST_SQL} SELECT run_tag, system, question_id, record_id, status, prediction FROM last",
    "repeated_records": "SELECT record_id, count(*) AS n FROM holdout_predictions GROUP BY 1 HAVING n > 1",
    "unexpected_questions": "SELECT DISTINCT question_id FROM holdout_predictions WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM manifest_examples)",
    "missing_questions": "SELECT DISTINCT question_id FROM manifest_examples WHERE question_id NOT IN (SELECT question_id FROM holdout_predictions WHERE status = 'ok' AND question_id IS NOT NULL AND run_tag = (SELECT max(run_tag) FROM holdout_predictions))",
    "status_coverage": """SELECT run_tag, system, status, count(*) AS n, count_if(question_id NOT IN (SELECT question_id FROM manifest_examples))::BIGINT AS unknown
FROM holdout_predictions GROUP BY ALL""",
    "resume_pending": """WITH e AS (SELECT run_tag, system, max(run_fingerprint_sha256) AS expected FROM holdout_predictions GROUP BY 1, 2)
SELECT run_tag, system, question_id FROM holdout_predictions JOIN e USING (run_tag, system)
GROUP BY ALL HAVING NOT coalesce(bool_or(status = 'ok' AND run_fingerprint_sha256 = expected), false)""",
    "fingerprint_coherence": """SELECT system, eval_day, count(DISTINCT run_fingerprint_sha256) AS fingerprints, count_if(run_fingerprint_sha256 IS NULL)::BIGINT AS unmarked
FROM holdout_predictions GROUP BY 1, 2 HAVING fingerprints <> 1 OR unmarked > 0""",
    "mixed_hardware": """SELECT run_tag, system, count(DISTINCT gpu_name) AS gpus, count(DISTINCT gpu_name) > 1 AS mixed,
  round(max(coalesce(peak_allocated_bytes, 0)) / 1073741824.0, 6)::DOUBLE AS peak_gib FROM holdout_final_analysis GROUP BY 1, 2""",
    "cap_flags": """SELECT run_tag, system, eval_day, count(generation_cap_reached) AS flags, CASE WHEN count(generation_cap_reached) > 0 THEN count_if(generation_cap_reached)::BIGINT END AS hits,
  count_if(generated_token_length >= coalesce(max_new_tokens, 64))::BIGINT AS inferred FROM holdout_predictions GROUP BY 1, 2, 3""",
    "long_outputs": """SELECT DISTINCT record_id, generated_token_length, length(prediction) AS chars FROM holdout_predictions
WHERE length(prediction) >= 80 OR generated_token_length >= 40 ORDER BY generated_token_length DESC, chars DESC NULLS LAST, record_id LIMIT 6""",
    "field_mismatches": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS n FROM internvl_error_sample_v1 a JOIN manifest_examples b USING (question_id) WHERE a.{c} IS DISTINCT FROM b.{c} HAVING count(*) > 0" for c in _FIELDS
    ),
}
