"""Whole jobs: predict, rescore, analyse a holdout, build a training subset."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge import schema
from docgauge.functions import text
from docgauge.functions.digests import hashed
from docgauge.functions.scoring import metrics
from docgauge.operators.bootstrap import attachable
from docgauge.operators.compare import delta_counts, paired
from docgauge.operators.digests import sequence_digest
from docgauge.operators.coverage import enforce, requested_set_summary, required_set, sidecar_report
from docgauge.operators.leakage import exclusion_reasons, group_key, overlap_counts
from docgauge.operators.resume import guard_append, pending
from docgauge.operators.sampling import take_groups
from docgauge.session import exists
from docgauge.sinks.reports import append_records, refuse_overwrite, stored, write_report
from docgauge.sources.documents import late_columns, read_answers, read_manifest, target
from docgauge.sources.jsonl import read_last

Predictor = Callable[[str], str]


def run_predictions(examples: DataFrame, make: Callable[[], Predictor], fingerprint: str, *, retry: bool = True) -> DataFrame:
    """A record for each example: answer, seconds, status.

    ``make`` builds the predictor once per task.  A failing row is tried once
    more, then recorded as an error.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for batch in batches:
            rows = []
            for key, question in zip(batch["question_id"], batch["question"]):
                began, answer, error = time.monotonic(), None, None
                for _ in range(1 + retry):
                    try:
                        answer, error = predictor(question), None
                        break
                    except Exception as fault:  # noqa: BLE001
                        error = f"{type(fault).__name__}: {fault}"
                rows.append((key, "ok" if error is None else "error", error, answer, time.monotonic() - began, fingerprint))
            yield pd.DataFrame(rows, columns=["question_id", "status", "error", "prediction", "generation_seconds", "run_fingerprint_sha256"])

    return examples.select("question_id", "question").mapInPandas(
        predict, "question_id long, status string, error string, prediction string, generation_seconds double, run_fingerprint_sha256 string"
    )


def resume_run(examples: DataFrame, store: str, make: Callable[[], Predictor], fingerprint: str) -> None:
    """Predicts what the store lacks and appends it; a store of another run is refused."""
    spark = examples.sparkSession
    kind = "question_id long, status string, error string, prediction string, generation_seconds double, run_fingerprint_sha256 string"
    left = examples
    if exists(spark, store):
        log = stored(spark, store, kind)
        guard_append(log, "run_fingerprint_sha256", fingerprint)
        left = examples.join(pending(examples, log, "question_id", "run_fingerprint_sha256", fingerprint), "question_id", "left_semi")
    append_records(run_predictions(left, make, fingerprint), store, ["question_id", "status", "run_fingerprint_sha256"])


def rescore(spark: SparkSession, manifest: str, answers: str, predictions: str, out: str, *, overwrite: bool = False) -> DataFrame:
    """Scores stored predictions anew: ``summary.json`` and ``rescored`` under ``out``.

    Cached metrics are ignored; what is missing scores 0; the last record of
    a question counts.
    """
    refuse_overwrite(spark, [f"{out}/summary.json", f"{out}/rescored"], overwrite=overwrite)
    required = required_set(read_manifest(spark, manifest)[1], "question_id")
    given = read_answers(spark, answers)
    valid = F.size(text.valid_references(F.col("answers"))) > 0
    enforce(sidecar_report(required, given, valid).where(F.col("problem") != "extra"), "answers")
    last = read_last(spark, predictions, schema.PREDICTION, "question_id").select("question_id", "status", "prediction", "generation_cap_reached")
    rows = required.join(last, "question_id", "left").join(given.select("question_id", "answers"), "question_id", "left")
    rows = rows.withColumn("m", metrics(F.col("prediction"), F.col("answers"), F.coalesce("status", F.lit("missing"))))
    rows.select("question_id", F.coalesce("status", F.lit("missing")).alias("status"), "prediction", F.col("m").alias("metrics")).write.mode("overwrite").json(f"{out}/rescored")
    there = rows.where(F.col("status").isNotNull())
    n = required.count()
    summary = requested_set_summary(there, F.lit(n), [], ok=F.col("m.scored"), score=F.col("m.strict"), exact=F.col("m.exact_match"), cap=F.col("generation_cap_reached"))
    write_report(summary, f"{out}/summary.json")
    return summary


def compare_runs(required: DataFrame, base: DataFrame, other: DataFrame, groups: DataFrame, interval: Mapping | None = None) -> dict:
    """Paired counts of two scored runs, digests of the inputs, and the interval if it belongs to them."""
    rows = paired(required, base, other, "question_id", "score").join(groups.select("question_id", "group"), "question_id", "left")
    counts = rows.agg(*delta_counts(F.col("delta"))).first().asDict()
    scores = F.concat_ws(":", F.col("question_id").cast("string"), F.col("group"), F.col("base").cast("string"), F.col("other").cast("string"))
    members = F.concat_ws(":", F.col("question_id").cast("string"), F.col("group"))
    digests = {name: (sequence_digest(rows, [], value, F.col("question_id")).first() or [None])[0] for name, value in (("scores_digest", scores), ("groups_digest", members))}
    attached, why = attachable(dict(interval or {}), digests)
    return {**counts, **digests, "interval": dict(interval) if interval and attached else None, "interval_state": why}


def build_train_subset(spark: SparkSession, source: str, blocked: Mapping[str, DataFrame], *, target_rows: int, seed: int = 42, buffer: int = 200, image: str = "image") -> tuple[DataFrame, DataFrame]:
    """(selected rows, rows by reason of exclusion) of parquet shards.

    Cheap columns are read first; whole document groups are taken in shuffled
    order up to the target and a buffer, and only their images are read.
    ``blocked`` has the tables question, ucsf, and image (digests), as wanted.
    """
    light = spark.read.parquet(source).select("question_id", "doc_id", "ucsf_document_id", "ucsf_document_page_no", "question", "answers", "target_answer")
    rows = light.withColumn("ucsf", text.optional_id(F.col("ucsf_document_id"))).withColumn("target", target(F.col("target_answer"), F.col("answers")))
    rules: dict = {"no_valid_answer": F.col("target").isNull()}
    if "question" in blocked:
        rules["question"] = ("question_id", blocked["question"])
    if "ucsf" in blocked:
        rules["ucsf"] = ("ucsf", blocked["ucsf"])
    marked = exclusion_reasons(rows, rules)
    key = group_key(F.col("ucsf"), F.col("doc_id"), F.col("ucsf_document_page_no"), F.lit(None).cast("string"))
    free = marked.where(F.col("reason").isNull()).withColumn("group_id", F.concat_ws("|", key["kind"], key["k1"], key["k2"]))
    sizes = free.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    candidates = free.join(take_groups(sizes, "group_id", "n", F.lit(target_rows + buffer), seed).select("group_id", "before"), "group_id")
    heavy = late_columns(spark, source, "question_id", candidates, [image]).select("question_id", F.sha2(image, 256).alias("image_sha256"))
    checked = candidates.join(heavy, "question_id", "left")
    if "image" in blocked:
        checked = exclusion_reasons(checked.drop("reason"), {"image": ("image_sha256", blocked["image"])})
    kept = checked.where(F.col("reason").isNull()).orderBy("before", hashed(seed, F.col("question_id")), "question_id").limit(target_rows)
    late = checked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return kept, marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(late)


def audit_splits(splits: Mapping[str, DataFrame], signals: Mapping[str, str]) -> DataFrame:
    """(first, second, signal, shared) for each pair of splits: a leak wherever shared is not 0."""
    names = sorted(splits)
    parts = [
        overlap_counts(splits[a], splits[b], {k: F.col(c) for k, c in signals.items()}).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "signal", "shared")
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cache_state(summary: Mapping | None, log: DataFrame | None, expected: Mapping[str, object], *, n_requested: int) -> tuple[str, list[str]]:
    """missing, incompatible or ok_complete for a stored evaluation, with what is wrong.

    Every expected field must be there and equal, and the log must hold one
    coherent fingerprint and as many questions as requested.
    """
    if summary is None or log is None:
        return "missing", ["no stored evaluation"]
    problems = [f"{k} is absent" for k in expected if k not in summary]
    problems += [f"{k} is {summary[k]!r}, not {v!r}" for k, v in expected.items() if k in summary and summary[k] != v]
    seen = log.agg(F.count_distinct("question_id").alias("q"), F.count_distinct("run_fingerprint_sha256").alias("f"), F.count(F.lit(1)).alias("n")).first()
    if seen["n"] and seen["f"] != 1:
        problems.append(f"{seen['f']} fingerprints in the log")
    if seen["q"] != n_requested:
        problems.append(f"{seen['q']} of {n_requested} questions in the log")
    return ("incompatible", problems) if problems else ("ok_complete", [])
