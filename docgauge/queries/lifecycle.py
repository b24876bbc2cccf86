"""Queries on the life of a run: records written and read again, resuming, fingerprints, streams, token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.digests import json_digest
from docgauge.functions.sequences import mask_runs, terminated, termination_fault
from docgauge.functions.text import json_document
from docgauge.operators.resume import run_states, weight_sets
from docgauge.plans.flows import run_predictions
from docgauge.queries.scoring import RUN
from docgauge.sinks.reports import append_records, stored
from docgauge.session import scratch, table
from docgauge.sources.jsonl import first_match, read_compatible, read_jsonl, read_last, read_once
from docgauge.streaming.scores import stream_once, stream_unique, windowed_latency

_LINE = "record_id long, question_id long, status string, run_fingerprint struct<run_fingerprint_sha256:string>"


def _lines(spark: SparkSession, folder: str) -> str:
    """The append log as JSON lines, written in the order of its records."""
    log = table(spark, folder, "holdout_predictions").select("record_id", "question_id", "status", F.struct("run_fingerprint_sha256").alias("run_fingerprint")).dropDuplicates(["record_id"])
    path = scratch(spark, "files")
    log.repartitionByRange("record_id").sortWithinPartitions("record_id").write.json(path)
    return path


def jsonl_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each question as it stands in the written lines."""
    return read_last(spark, _lines(spark, folder), _LINE, "question_id").select("question_id", "record_id")


def jsonl_compatible(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the run with the largest fingerprint, and of other runs."""
    path = _lines(spark, folder)
    wanted = table(spark, folder, "holdout_predictions").agg(F.max("run_fingerprint_sha256")).first()[0]
    same, other = read_compatible(spark, path, _LINE, wanted)
    return same.select(F.lit("same").alias("run"), "status").unionByName(other.select(F.lit("other").alias("run"), "status")).groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"))


def jsonl_first_error(spark: SparkSession, folder: str) -> DataFrame:
    """The first line that is an error."""
    return first_match(read_jsonl(spark, _lines(spark, folder), _LINE), F.col("status") == "error").select("record_id", "question_id")


def jsonl_unique(spark: SparkSession, folder: str) -> DataFrame:
    """The question list as lines, read where repeated and unknown questions raise."""
    rows = table(spark, folder, "manifest_examples").select("question_id", "doc_id")
    path = scratch(spark, "files")
    rows.write.json(path)
    return read_once(spark, path, "question_id long, doc_id long", "question_id", rows)


def appended_once(spark: SparkSession, folder: str) -> DataFrame:
    """The log appended to a store twice over, of which nothing is there twice."""
    log = table(spark, folder, "holdout_predictions").select("record_id", "system", "status", "logged_at")
    store = scratch(spark, "files")
    for _ in range(2):
        append_records(log, store, ["record_id"], order=["logged_at", "status"])
    return stored(spark, store, log.schema).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream, scored once into a store, though the stream is run twice from its start."""
    kind = spark.read.parquet(f"{folder}/holdout_predictions.parquet").schema
    store, source = scratch(spark, "files"), f"{folder}/holdout_predictions.parquet"
    score = F.when(F.col("status") == "ok", F.coalesce("metrics.anls_normalized_strict_v2", F.lit(0.0))).otherwise(F.lit(0.0))
    scored = lambda batch: batch.groupBy("record_id").agg(F.min("system").alias("system"), F.min(score).alias("score"))
    for _ in range(2):
        stream_once(spark, source, kind, store, scratch(spark, "files"), ["record_id"], scored).awaitTermination()
    return stored(spark, store, "record_id long, system string, score double").groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


def stream_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries as a stream, each batch with one row per question, merged by a store."""
    source = f"{folder}/internvl_error_sample_v1.parquet"
    kind, store = spark.read.parquet(source).schema, scratch(spark, "files")
    keep = ["question_id", "received_at", "delivery_id"]
    sink = lambda batch, _: append_records(batch.select(*keep), store, ["question_id"], order=["received_at", "delivery_id"])
    stream_unique(spark, source, kind, scratch(spark, "files"), sink, "question_id", ["received_at", "delivery_id"]).awaitTermination()
    return stored(spark, store, spark.read.parquet(source).select(*keep).schema).select("question_id", "delivery_id")


def daily_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and seconds of each system and day of logging, from the means that the stream gives."""
    log = table(spark, folder, "holdout_predictions").where((F.col("status") == "ok") & (F.col("generation_seconds") > 0) & ~F.isnan("generation_seconds") & (F.col("generation_seconds") < 1e6))
    return windowed_latency(log, time="logged_at").select("start", "system", "n", F.round(F.col("mean_seconds") * F.col("n"), 6).alias("seconds"))


def cache_states(spark: SparkSession, folder: str) -> DataFrame:
    """Of each published run whether its log can be used again, and why not."""
    published = table(spark, folder, "holdout_final_analysis").where(F.col("eval_day").isNull())
    expected = published.groupBy(*RUN).agg(F.max("n_requested").alias("expected"))
    log = table(spark, folder, "holdout_predictions")
    return run_states(log, expected, RUN, "record_id", "run_fingerprint_sha256", least=0.999)


def fingerprint_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Of each run whether exactly one fingerprint made it, and the one it should be."""
    log = table(spark, folder, "holdout_predictions")
    wanted = log.groupBy(*RUN).agg(F.max("run_fingerprint_sha256").alias("wanted"))
    return weight_sets(log, wanted, RUN, "run_fingerprint_sha256")


def settings_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of the settings of each run and tile cap; the cap counts, so runs of other caps are not mixed up."""
    rows = table(spark, folder, "holdout_predictions").select("run_tag", "system", "max_new_tokens", F.col("image_info.max_num").alias("max_num")).where(F.col("max_num").isNotNull() & F.col("max_new_tokens").isNotNull()).distinct()
    digest = json_digest({"run_tag": F.col("run_tag"), "system": F.col("system"), "max_new_tokens": F.col("max_new_tokens"), "max_num": F.col("max_num"), "do_sample": F.lit(False), "adapter_dir": F.lit(None).cast("string")})
    return rows.select("*", digest.alias("digest"))


def stub_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A predictor run over the question list: some questions fail, twice, and are recorded as errors."""
    rows = table(spark, folder, "manifest_examples").select("question_id", "question")

    def make():
        def answer(question: str) -> str:
            if question.endswith("?") and len(question) < 40:
                raise ValueError("short question")
            return question.split(" ", 1)[0].upper()

        return answer

    made = run_predictions(rows, make, "stub")
    return made.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prediction").alias("answers"), F.count_if(F.col("generation_seconds") >= 0).alias("timed"))


# Characters stand for tokens: the supervised sequence of a record is its
# question and its answer, and a full stop is the end token.
_END = 46


def _ids(c: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x))


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "internvl_error_sample_v1").select("delivery_id", "question", "prediction")
    return rows.select("delivery_id", F.size(_ids(F.col("question"))).alias("prompt"), F.concat(_ids(F.col("question")), _ids(F.col("prediction"))).alias("ids"))


def termination_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How supervised sequences end, before and after they are cut at the first end token or given one."""
    rows = _sequences(spark, folder).withColumn("fixed", terminated(F.col("ids"), F.col("prompt"), F.lit(_END)))
    before, after = termination_fault(F.col("ids"), F.col("prompt"), F.lit(_END)), termination_fault(F.col("fixed"), F.col("prompt"), F.lit(_END))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(before == "empty").alias("empty"), F.count_if(before == "no end").alias("without_end"), F.count_if(before == "several ends").alias("several"),
        F.count_if(before == "end not last").alias("not_last"), F.count_if(before.isNull()).alias("sound"), F.count_if(F.size("fixed") < F.size("ids")).alias("shortened"),
        F.count_if(F.size("fixed") > F.size("ids")).alias("given_one"), F.count_if(F.col("fixed").isNotNull() & after.isNotNull()).alias("still_wrong"),
    )


def masked_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the supervised sequences as text: the question is masked."""
    rows = table(spark, folder, "internvl_error_sample_v1").select("delivery_id", "question", "prediction")
    masked = F.transform(_ids(F.col("question")), lambda _: F.lit(-100))
    return rows.select("delivery_id", mask_runs(F.concat(masked, _ids(F.col("prediction")))).alias("labels"))


def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as JSON documents, some cut off, some without the key that must be there."""
    rows = table(spark, folder, "holdout_predictions").select("system", "record_id", "status", "generated_token_length")
    written = F.when(F.col("status") == "ok", F.concat(F.lit(' {"record": '), F.col("record_id").cast("string"), F.lit(', "tokens": '), F.coalesce(F.col("generated_token_length").cast("string"), F.lit("null")), F.lit("}\n"))).otherwise(F.concat(F.lit('{"record": '), F.col("record_id").cast("string")))
    parsed = json_document(written, "record long, tokens int", ["record", "tokens"])
    return rows.select("system", parsed.alias("p")).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("complete"), F.sum("p.tokens").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_last_wins, jsonl_compatible, jsonl_first_error, jsonl_unique, appended_once, stream_scores, stream_deliveries, daily_latency, cache_states, fingerprint_sets,
        settings_fingerprints, stub_predictions, termination_audit, masked_labels, json_answers,
    )
}

_ONCE = "l AS (SELECT record_id, min(question_id) AS question_id, min(status) AS status, min(run_fingerprint_sha256) AS fp FROM holdout_predictions GROUP BY 1)"
_CHARS = "list_transform(string_split(coalesce({0}, ''), ''), lambda x: ascii(x))"
SQL = {
    "jsonl_last_wins": "SELECT question_id, max(record_id) AS record_id FROM holdout_predictions GROUP BY 1",
    "jsonl_compatible": f"""WITH {_ONCE} SELECT CASE WHEN fp = (SELECT max(run_fingerprint_sha256) FROM holdout_predictions) THEN 'same' ELSE 'other' END AS run, status, count(*) AS n FROM l GROUP BY 1, 2""",
    "jsonl_first_error": f"WITH {_ONCE} SELECT record_id, question_id FROM l WHERE status = 'error' ORDER BY record_id LIMIT 1",
    "jsonl_unique": "SELECT question_id, doc_id FROM manifest_examples",
    "appended_once": "SELECT system, count(*) AS n, count(*) AS records FROM (SELECT record_id, arg_min(system, (logged_at, status)) AS system FROM holdout_predictions GROUP BY 1) GROUP BY 1",
    "stream_scores": """SELECT system, count(*) AS n, round(avg(score), 6) AS score FROM (SELECT record_id, min(system) AS system,
  min(CASE WHEN status = 'ok' THEN coalesce(metrics.anls_normalized_strict_v2, 0.0) ELSE 0.0 END) AS score FROM holdout_predictions GROUP BY 1) GROUP BY 1""",
    "stream_deliveries": "SELECT question_id, delivery_id FROM internvl_error_sample_v1 QUALIFY question_id IS NULL OR row_number() OVER (PARTITION BY question_id ORDER BY received_at NULLS LAST, delivery_id) = 1",
    "daily_latency": """SELECT date_trunc('day', logged_at)::TIMESTAMP AS start, system, count(*) AS n, round(sum(generation_seconds), 6) AS seconds FROM holdout_predictions
WHERE status = 'ok' AND generation_seconds > 0 AND isfinite(generation_seconds) AND generation_seconds < 1e6 AND logged_at IS NOT NULL GROUP BY 1, 2""",
    "cache_states": """WITH e AS (SELECT run_tag, system, max(n_requested) AS expected FROM holdout_final_analysis WHERE eval_day IS NULL GROUP BY 1, 2),
l AS (SELECT run_tag, system, count(DISTINCT record_id) AS n, count(DISTINCT run_fingerprint_sha256) AS f, count_if(run_fingerprint_sha256 IS NULL) AS unmarked FROM holdout_predictions GROUP BY 1, 2),
s AS (SELECT e.*, coalesce(n, 0) AS found, list_filter([CASE WHEN n > 0 AND (f <> 1 OR unmarked > 0) THEN 'fingerprints' END, CASE WHEN n > 0 AND n < 0.999 * expected THEN 'too few' END, CASE WHEN n > expected THEN 'too many' END], lambda x: x IS NOT NULL) AS p
  FROM e LEFT JOIN l USING (run_tag, system))
SELECT run_tag, system, CASE WHEN found = 0 THEN 'missing' WHEN len(p) > 0 THEN 'incompatible' ELSE 'ok_complete' END AS state, array_to_string(p, ',') AS problems, expected, found FROM s""",
    "fingerprint_sets": """WITH w AS (SELECT run_tag, system, max(run_fingerprint_sha256) AS wanted FROM holdout_predictions GROUP BY 1, 2)
SELECT run_tag, system, count(DISTINCT run_fingerprint_sha256) AS kinds, coalesce(bool_and(run_fingerprint_sha256 = wanted) FILTER (run_fingerprint_sha256 IS NOT NULL), false) AND count(*) = count(run_fingerprint_sha256) AS as_wanted
FROM holdout_predictions JOIN w USING (run_tag, system) GROUP BY 1, 2""",
    "settings_fingerprints": """WITH s AS (SELECT DISTINCT run_tag, system, max_new_tokens, image_info.max_num AS max_num FROM holdout_predictions WHERE image_info.max_num IS NOT NULL AND max_new_tokens IS NOT NULL)
SELECT *, sha256('{"adapter_dir":null,"do_sample":false,"max_new_tokens":' || max_new_tokens || ',"max_num":' || max_num || ',"run_tag":"' || run_tag || '","system":"' || system || '"}') AS digest FROM s""",
    "stub_predictions": """WITH p AS (SELECT (right(question, 1) = '?' AND length(question) < 40) AS bad, upper(split_part(question, ' ', 1)) AS a FROM manifest_examples WHERE question IS NOT NULL)
SELECT CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 'ValueError: short question' END AS error, count(*) AS n, count(DISTINCT CASE WHEN NOT bad THEN a END) AS answers, count(*) AS timed FROM p GROUP BY bad""",
    "termination_audit": f"""WITH s AS (SELECT {_CHARS.format('prediction')} AS a, coalesce(prediction, '') = '' AS none FROM internvl_error_sample_v1),
k AS (SELECT none, len(a) AS n, len(list_filter(a, lambda x: x = {_END})) AS ends, list_position(a, {_END}) AS first, a[-1] = {_END} AS closed FROM s)
SELECT count(*) AS n, count_if(none)::BIGINT AS empty, count_if(NOT none AND ends = 0)::BIGINT AS without_end, count_if(ends > 1)::BIGINT AS several, count_if(ends = 1 AND NOT closed)::BIGINT AS not_last,
  count_if(ends = 1 AND closed)::BIGINT AS sound, count_if(ends > 0 AND first < n)::BIGINT AS shortened, count_if(NOT none AND ends = 0)::BIGINT AS given_one, 0::BIGINT AS still_wrong FROM k""",
    "masked_labels": f"""SELECT delivery_id, trim(CASE WHEN coalesce(question, '') <> '' THEN '[MASK×' || length(question) || '] ' ELSE '' END
  || CASE WHEN coalesce(prediction, '') <> '' THEN array_to_string({_CHARS.format('prediction')}, ' ') ELSE '' END) AS labels FROM internvl_error_sample_v1""",
    "json_answers": """SELECT system, count(*) AS n, count(CASE WHEN status = 'ok' AND generated_token_length IS NOT NULL THEN 1 END) AS complete,
  sum(CASE WHEN status = 'ok' THEN generated_token_length END)::BIGINT AS tokens FROM holdout_predictions GROUP BY 1""",
}
