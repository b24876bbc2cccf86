"""Queries that score answers against references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import text
from docgauge.functions.scoring import metrics
from docgauge.operators.coverage import last_by_key, requested_set_summary, sidecar_report
from docgauge.session import table

RUN = ["run_tag", "system"]


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, references): one row per question, repeated entries put together."""
    answers = table(spark, folder, "answer_sidecar").where(F.col("question_id").isNotNull())
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_list(text.valid_references(F.col("answers"))))))
    return answers.groupBy("question_id").agg(listed.alias("references"))


def last_records(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The last record of each run, system and question, by logging time, then record."""
    log = table(spark, folder, "holdout_predictions").where(~F.col("is_warmup"))
    return last_by_key(log.select(*RUN, "question_id", "logged_at", "record_id", *columns), [*RUN, "question_id"], ["logged_at", "record_id"])


def scored_records(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Last records of required questions with their recomputed metrics."""
    required = table(spark, folder, "manifest_examples").select("question_id").distinct()
    last = last_records(spark, folder, ["status", "prediction", *(columns or [])]).join(required, "question_id", "left_semi")
    joined = last.join(references(spark, folder), "question_id", "left")
    return joined.withColumn("m", metrics(F.col("prediction"), F.col("references"), F.col("status")))


def requested_set_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_records(spark, folder, ["generation_cap_reached"])
    n = table(spark, folder, "manifest_examples").agg(F.count_distinct("question_id")).scalar()
    summary = requested_set_summary(scored, n, RUN, ok=F.col("m.scored"), score=F.col("m.strict"), exact=F.col("m.exact_match"), cap=F.col("generation_cap_reached"))
    return _rounded(summary, "mean_score", "mean_exact", "failure_rate", "ok_mean_score")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def score_variants(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_records(spark, folder).where(F.col("m.scored"))
    p, r = F.col("prediction"), F.col("references")
    return _rounded(
        scored.groupBy("system").agg(
            F.count(F.lit(1)).alias("n"), F.avg("m.strict").alias("strict"), F.avg("m.inclusive").alias("inclusive"), F.avg("m.raw_length").alias("raw_length"),
            F.avg("m.exact_match").alias("exact_match"), F.avg(text.exact_without_period(p, r)).alias("without_period"),
            F.count_if(F.col("m.strict") != F.col("m.inclusive")).alias("differing"), F.count_if(F.col("m.invalid_references")).alias("without_reference"),
        ),
        "strict", "inclusive", "raw_length", "exact_match", "without_period",
    )


def formatting_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Exact matches with and without a final full stop, and answers that end with one."""
    scored = scored_records(spark, folder).where(F.col("m.scored"))
    loose = text.exact_without_period(F.col("prediction"), F.col("references"))
    strict = F.col("m.exact_match")
    counts = scored.groupBy(*RUN).agg(
        F.count_if(strict == 1).alias("exact"), F.count_if(loose == 1).alias("loose"),
        F.count_if((loose == 1) & (strict == 0)).alias("newly_matched"), F.count_if(loose == 0).alias("still_unmatched"),
        F.count_if(text.ends_with_period(F.col("prediction"))).alias("ends_with_period"),
    )
    return counts


def error_tags(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_records(spark, folder).where(F.col("m.scored") & (F.col("m.exact_match") == 0))
    tag = text.error_tag(F.col("prediction"), F.col("references"))
    held = text.contained_either_way(F.col("prediction"), F.col("references"))
    return scored.groupBy("system", tag.alias("tag"), held.alias("contained")).agg(F.count(F.lit(1)).alias("n"))


def sidecar_problems(spark: SparkSession, folder: str) -> DataFrame:
    required = table(spark, folder, "manifest_examples").select("question_id").distinct()
    answers = table(spark, folder, "answer_sidecar")
    return sidecar_report(required, answers, F.size(text.valid_references(F.col("answers"))) > 0)


def chosen_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The training target of each manifest row: its own, else the first valid answer, and whether the two differ."""
    answers = table(spark, folder, "answer_sidecar").groupBy("question_id").agg(F.min(text.first_valid(F.col("answers"))).alias("first_answer"))
    rows = table(spark, folder, "manifest_examples").select("question_id", "target_answer").join(answers, "question_id", "left")
    own = F.nullif(text.strip(F.col("target_answer")), F.lit(""))
    return rows.select("question_id", F.coalesce(own, F.col("first_answer")).alias("target"), F.coalesce(own != F.col("first_answer"), F.lit(False)).alias("differs"))


def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    n = text.normalize(F.col("text"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(n)).alias("chars"), F.count_if(n == F.col("text")).alias("unchanged"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "internvl_error_sample_v1")
    return rows.select(
        "delivery_id", text.prompt(F.col("question"), "Answer with a short phrase.").alias("prompt"),
        text.cut_at(F.col("prediction"), ",").alias("first_part"), text.echoes_prompt(F.col("prediction"), F.col("question")).alias("echo"),
    )


QUERIES = {
    "requested_set_score": requested_set_score, "score_variants": score_variants, "formatting_diagnostics": formatting_diagnostics,
    "error_tags": error_tags, "sidecar_problems": sidecar_problems, "chosen_targets": chosen_targets,
    "normalized_texts": normalized_texts, "prompts": prompts,
}

# The oracle's levenshtein counts bytes: letters beyond ASCII are first put in
# bijection with capitals, which normalised texts don't contain.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _n(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{_SPACE}', ' ', 'g'))"


def _a(x: str) -> str:
    return f"translate({_n(x)}, 'éßûïóäçúáèñíüôêàöâîùœ¿', 'ABCDEFGHIJKLMNOPQRSTUV')"


def _upper_length(x: str) -> str:
    return f"length(replace(replace(upper({x}), 'ẞ', 'SS'), 'ß', 'SS'))"


_VALID = f"list_filter(coalesce(answers, []), lambda r: r IS NOT NULL AND {_n('r')} <> '')"
REFERENCES_SQL = f"refs AS (SELECT question_id, list_distinct(flatten(list({_VALID}))) AS refs FROM answer_sidecar WHERE question_id IS NOT NULL GROUP BY 1)"
LAST_SQL = """last AS (SELECT * FROM holdout_predictions WHERE NOT is_warmup
  QUALIFY row_number() OVER (PARTITION BY run_tag, system, question_id ORDER BY logged_at DESC, record_id DESC) = 1)"""
_P = "coalesce(prediction, '')"
_LONG = f"greatest(length({_a('r')}), length({_a(_P)}))"
_DIST = f"levenshtein({_a('r')}, {_a(_P)})"
_STRICT = f"CASE WHEN {_n(_P)} = '' THEN 0.0 WHEN {_DIST} / {_LONG} < 0.5 THEN 1.0 - {_DIST} / {_LONG} ELSE 0.0 END"
_INCLUSIVE = f"CASE WHEN 1.0 - {_DIST} / {_LONG} >= 0.5 THEN 1.0 - {_DIST} / {_LONG} ELSE 0.0 END"
_RAW = f"({_DIST} / greatest({_upper_length('r')}, {_upper_length(_P)}))"
SCORED_SQL = f"""WITH {REFERENCES_SQL}, {LAST_SQL},
base AS (SELECT l.*, coalesce(refs, []) AS refs, status = 'ok' AND prediction IS NOT NULL AS good
  FROM last l LEFT JOIN refs USING (question_id) WHERE question_id IN (SELECT question_id FROM manifest_examples)),
scored AS (SELECT *,
  CASE WHEN good THEN coalesce(list_max(list_transform(refs, lambda r: {_STRICT})), 0.0) ELSE 0.0 END::DOUBLE AS strict,
  CASE WHEN good THEN coalesce(list_max(list_transform(refs, lambda r: {_INCLUSIVE})), 0.0) ELSE 0.0 END::DOUBLE AS inclusive,
  CASE WHEN good THEN coalesce(CASE WHEN 1 - list_min(list_transform(refs, lambda r: {_RAW})) >= 0.5 THEN 1 - list_min(list_transform(refs, lambda r: {_RAW})) ELSE 0.0 END, 0.0) ELSE 0.0 END::DOUBLE AS raw_length,
  (good AND len(list_filter(refs, lambda r: {_n('r')} = {_n(_P)})) > 0)::INT::DOUBLE AS exact_match,
  (good AND len(list_filter(refs, lambda r: regexp_replace({_n('r')}, '\\.$', '') = regexp_replace({_n(_P)}, '\\.$', ''))) > 0)::INT::DOUBLE AS loose
  FROM base)"""
_NOSPACE = lambda x: f"replace({_n(x)}, ' ', '')"

SQL = {
    "requested_set_score": f"""{SCORED_SQL}, n AS (SELECT count(DISTINCT question_id) AS n FROM manifest_examples)
SELECT run_tag, system, max(n) AS n_requested, count_if(good)::BIGINT AS n_ok, count_if(NOT good)::BIGINT AS n_failed,
  (max(n) - count(*))::BIGINT AS n_missing, count_if(good AND coalesce(generation_cap_reached, false))::BIGINT AS n_cap_hits,
  round(sum(strict) / max(n), 6) AS mean_score, round(sum(exact_match) / max(n), 6) AS mean_exact,
  round((max(n) - count_if(good)) / max(n), 6) AS failure_rate, round(sum(strict) / nullif(count_if(good), 0), 6) AS ok_mean_score
FROM scored, n GROUP BY run_tag, system""",
    "score_variants": f"""{SCORED_SQL} SELECT system, count(*) AS n, round(avg(strict), 6) AS strict, round(avg(inclusive), 6) AS inclusive,
  round(avg(raw_length), 6) AS raw_length, round(avg(exact_match), 6) AS exact_match, round(avg(loose), 6) AS without_period,
  count_if(strict <> inclusive)::BIGINT AS differing, count_if(len(refs) = 0)::BIGINT AS without_reference FROM scored WHERE good GROUP BY system""",
    "formatting_diagnostics": f"""{SCORED_SQL} SELECT run_tag, system, count_if(exact_match = 1)::BIGINT AS exact, count_if(loose = 1)::BIGINT AS loose,
  count_if(loose = 1 AND exact_match = 0)::BIGINT AS newly_matched, count_if(loose = 0)::BIGINT AS still_unmatched,
  count_if(ends_with(prediction, '.'))::BIGINT AS ends_with_period FROM scored WHERE good GROUP BY run_tag, system""",
    "error_tags": f"""{SCORED_SQL} SELECT system,
  CASE WHEN loose = 1 OR len(list_filter(refs, lambda r: {_NOSPACE('r')} = {_NOSPACE(_P)})) > 0 THEN 'formatting'
    WHEN {_n(_P)} <> '' AND len(list_filter(refs, lambda r: contains({_n('r')}, {_n(_P)}) OR contains({_n(_P)}, {_n('r')}))) > 0 THEN 'partial' ELSE 'content' END AS tag,
  len(list_filter(refs, lambda r: contains({_n('r')}, {_n(_P)}) OR contains({_n(_P)}, {_n('r')}))) > 0 AS contained, count(*) AS n
FROM scored WHERE good AND exact_match = 0 GROUP BY 1, 2, 3""",
    "sidecar_problems": f"""WITH k AS (SELECT question_id, count(*) AS n, bool_or(len({_VALID}) > 0) AS valid FROM answer_sidecar GROUP BY 1),
b AS (SELECT question_id, m.q IS NOT NULL AS wanted, n, valid FROM k FULL JOIN (SELECT DISTINCT question_id, 1 AS q FROM manifest_examples) m USING (question_id))
SELECT question_id, 'missing' AS problem FROM b WHERE n IS NULL UNION ALL SELECT question_id, 'extra' FROM b WHERE NOT wanted
UNION ALL SELECT question_id, 'repeated' FROM b WHERE n > 1 UNION ALL SELECT question_id, 'invalid' FROM b WHERE wanted AND NOT valid""",
    "chosen_targets": r"""WITH f AS (SELECT question_id, min(trim(list_filter(answers, lambda r: trim(r, E' \t\n\r') <> '')[1], E' \t\n\r')) AS a FROM answer_sidecar GROUP BY 1)
SELECT question_id, coalesce(nullif(trim(target_answer, E' \t\n\r'), ''), a) AS target,
  coalesce(nullif(trim(target_answer, E' \t\n\r'), '') <> a, false) AS differs FROM manifest_examples LEFT JOIN f USING (question_id)""",
    "normalized_texts": f"SELECT lang, count(*) AS n, sum(length({_n('text')}))::BIGINT AS chars, count_if({_n('text')} = text)::BIGINT AS unchanged FROM documents GROUP BY lang",
    "prompts": rf"""SELECT delivery_id, concat_ws(chr(10), regexp_replace(question, '^{_SPACE}|{_SPACE}$', '', 'g'), 'Answer with a short phrase.') AS prompt,
  regexp_replace(split_part(prediction, ',', 1), '^{_SPACE}|{_SPACE}$', '', 'g') AS first_part,
  coalesce(contains({_n('prediction')}, {_n('question')}) AND {_n('question')} <> '', false) AS echo FROM internvl_error_sample_v1""",
}
