"""Queries that compare runs and pick examples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.functions.text import normalize
from docgauge.operators.compare import TIE, agreement, best_step, delta_counts, paired_conditions, verdict
from docgauge.queries.scoring import RUN, last_records
from docgauge.session import table

BASE, OTHER, THIRD = "glyphvl_1b", "glyphvl_1b_lora_a", "glyphvl_1b_lora_b"
KEY = ["run_tag", "question_id"]


def _scores(spark: SparkSession, folder: str, *, named: bool = True) -> DataFrame:
    """Last records of the ``named`` or of all systems with the stored strict score, 0 for what is not ok."""
    rows = last_records(spark, folder, ["status", "prediction", "metrics"])
    if named:
        rows = rows.where(F.col("system").isin(BASE, OTHER, THIRD))
    ok = F.col("status") == "ok"
    score = F.when(ok, F.coalesce("metrics.anls_normalized_strict_v2", F.lit(0.0))).otherwise(F.lit(0.0))
    exact = F.when(ok, F.coalesce("metrics.exact_match", F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.select(*KEY, "system", "status", "prediction", score.alias("score"), exact.alias("exact"))


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """Every question of a run with the scores of the base and the adapted system; missing is 0."""
    both = paired_conditions(_scores(spark, folder), KEY, "system", [BASE, OTHER], F.col("score"))
    return both.select(*KEY, F.coalesce(BASE, F.lit(0.0)).alias("base"), F.coalesce(OTHER, F.lit(0.0)).alias("other")).withColumn("delta", F.col("other") - F.col("base"))


def paired_runs(spark: SparkSession, folder: str) -> DataFrame:
    counts = _paired(spark, folder).groupBy("run_tag").agg(*delta_counts(F.col("delta")))
    return counts.withColumns({c: F.round(c, 6) for c in ("sum_gain", "sum_loss", "mean_delta")})


def paired_ok_only(spark: SparkSession, folder: str) -> DataFrame:
    """The same where both systems have an ok record: others are skipped, not 0."""
    ok = _scores(spark, folder).where(F.col("status") == "ok")
    both = paired_conditions(ok, KEY, "system", [BASE, OTHER], F.col("score")).where(F.col(BASE).isNotNull() & F.col(OTHER).isNotNull())
    judged = both.groupBy(verdict(F.col(OTHER) - F.col(BASE)).alias("verdict"))
    return judged.agg(F.count(F.lit(1)).alias("n"))


def three_way(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by what the two adapted systems did to the base's answer."""
    wide = paired_conditions(_scores(spark, folder), KEY, "system", [BASE, OTHER, THIRD], F.col("score")).na.drop()
    a, b = verdict(F.col(OTHER) - F.col(BASE)).alias("first"), verdict(F.col(THIRD) - F.col(BASE)).alias("second")
    return wide.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def answers_agree(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of answers that agree, differ, or cannot be compared."""
    rows = _scores(spark, folder)
    wide = rows.groupBy(*KEY).agg(*[F.max(F.when(F.col("system") == s, F.struct("status", "prediction"))).alias(s) for s in (BASE, OTHER)])
    same = agreement(F.col(f"{BASE}.status"), F.col(f"{BASE}.prediction"), F.col(f"{OTHER}.status"), F.col(f"{OTHER}.prediction"))
    return wide.groupBy("run_tag", same.alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


def _delta_to_base(rows: DataFrame) -> DataFrame:
    means = rows.groupBy("run_tag", "system").agg(F.avg("score").alias("score"), F.avg("exact").alias("exact"))
    base = F.max(F.when(F.col("system") == BASE, F.col("score"))).over(Window.partitionBy("run_tag"))
    return means.select("run_tag", "system", F.round("score", 6).alias("score"), F.round("exact", 6).alias("exact"), F.round(F.col("score") - base, 6).alias("delta"))


def delta_to_base(spark: SparkSession, folder: str) -> DataFrame:
    """Mean score of each named system and run, and its difference to the base system of the run."""
    return _delta_to_base(_scores(spark, folder))


def delta_to_base_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every system of the log."""
    return _delta_to_base(_scores(spark, folder, named=False))


def _wide_predictions(rows: DataFrame, systems: Iterable[str]) -> DataFrame:
    columns = []
    for name in systems:
        here = F.col("system") == name
        columns += [F.max(F.when(here, F.coalesce("prediction", F.lit("(missing)")))).alias(f"pred_{name}"), F.max(F.when(here, F.col("score"))).alias(f"score_{name}")]
    return rows.groupBy(*KEY).agg(*columns)


def wide_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per question with each named system's answer and score side by side."""
    return _wide_predictions(_scores(spark, folder), (BASE, OTHER, THIRD))


def wide_predictions_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every system of the log."""
    found = table(spark, folder, "holdout_predictions").where(~F.col("is_warmup") & F.col("system").isNotNull()).select("system").distinct().collect()
    return _wide_predictions(_scores(spark, folder, named=False), sorted(r.system for r in found))


def best_run(spark: SparkSession, folder: str) -> DataFrame:
    """The run with the best mean of the adapted system; of equals, the earliest."""
    means = _scores(spark, folder).where(F.col("system") == OTHER).groupBy("run_tag").agg(F.round(F.avg("score"), 6).alias("score"))
    return best_step(means, "run_tag", "score")


def top_gains(spark: SparkSession, folder: str) -> DataFrame:
    return _paired(spark, folder).select(*KEY, F.round("delta", 6).alias("delta")).orderBy(F.desc("delta"), "run_tag", "question_id").limit(10)


def top_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Largest changes either way; of equals, the largest key."""
    rows = _paired(spark, folder).select(*KEY, F.round("delta", 6).alias("delta"))
    return rows.orderBy(F.desc(F.abs("delta")), F.desc("run_tag"), F.desc("question_id")).limit(3)


def gains_then_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Improved questions by gain, then regressed ones by loss, numbered through for each run."""
    rows = _paired(spark, folder).select(*KEY, F.round("delta", 6).alias("delta")).where(F.abs("delta") > TIE)
    section = F.when(F.col("delta") > 0, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("run_tag", section).orderBy(F.desc(F.abs("delta")), "question_id"))
    return rows.select(*KEY, "delta", section.alias("section"), place.alias("place")).where(F.col("place") <= 20)


def _gallery_picks(scores: DataFrame) -> DataFrame:
    rows = scores.withColumn("key", F.concat_ws("/", "run_tag", F.lpad(F.col("question_id").cast("string"), 12, "0")))
    wrong = (F.col("score") == 0) & (normalize(F.coalesce("prediction", F.lit(""))) != "")
    return rows.groupBy("system").agg(
        F.min(F.when(F.col("exact") == 1, F.col("key"))).alias("first_exact"), F.min(F.when(wrong, F.col("key"))).alias("first_error"),
        F.min(F.struct("score", "key"))["key"].alias("lowest"),
    )


def gallery_picks(spark: SparkSession, folder: str) -> DataFrame:
    """For each named system the first exact answer, the first substantive error, and the first of the lowest score."""
    return _gallery_picks(_scores(spark, folder))


def gallery_picks_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every system of the log."""
    return _gallery_picks(_scores(spark, folder, named=False))


def ranked_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Four questions of each run: those whose answers differ first, then the same, then the rest."""
    rows = _scores(spark, folder)
    wide = rows.groupBy(*KEY).agg(*[F.max(F.when(F.col("system") == s, F.struct("status", "prediction"))).alias(s) for s in (BASE, OTHER)])
    same = agreement(F.col(f"{BASE}.status"), F.col(f"{BASE}.prediction"), F.col(f"{OTHER}.status"), F.col(f"{OTHER}.prediction"))
    rank = F.when(~same, 0).when(same, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("run_tag").orderBy("rank", "question_id"))
    return wide.select(*KEY, rank.alias("rank")).withColumn("place", place).where(F.col("place") <= 4)


def not_perfect(spark: SparkSession, folder: str) -> DataFrame:
    """Ok records that are neither an exact match nor of full similarity."""
    m = F.col("metrics")
    perfect = (m["exact_match"] >= 1 - TIE) & (m["anls_normalized_strict_v2"].isNull() | (m["anls_normalized_strict_v2"] >= 1 - TIE))
    rows = table(spark, folder, "holdout_predictions").where((F.col("status") == "ok") & ~F.coalesce(perfect, F.lit(False)))
    return rows.groupBy(*RUN).agg(F.count_distinct("record_id").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        paired_runs, paired_ok_only, three_way, answers_agree, delta_to_base, wide_predictions, best_run, top_gains, top_changes,
        gains_then_losses, gallery_picks, ranked_fill, not_perfect, delta_to_base_all, wide_predictions_all, gallery_picks_all,
    )
}

_S = f"""WITH s AS (SELECT run_tag, question_id, system, status, prediction,
  CASE WHEN status = 'ok' THEN coalesce(metrics.anls_normalized_strict_v2, 0.0) ELSE 0.0 END AS score,
  CASE WHEN status = 'ok' THEN coalesce(metrics.exact_match, 0.0) ELSE 0.0 END AS exact
  FROM holdout_predictions WHERE NOT is_warmup AND system IN ('{BASE}', '{OTHER}', '{THIRD}')
  QUALIFY row_number() OVER (PARTITION BY run_tag, system, question_id ORDER BY logged_at DESC, record_id DESC) = 1),
w AS (SELECT run_tag, question_id, max(score) FILTER (system = '{BASE}') AS a, max(score) FILTER (system = '{OTHER}') AS b, max(score) FILTER (system = '{THIRD}') AS c FROM s GROUP BY 1, 2),
p AS (SELECT run_tag, question_id, coalesce(b, 0.0) - coalesce(a, 0.0) AS delta FROM w)"""
_V = "CASE WHEN {0} > 1e-12 THEN 'improved' WHEN {0} < -1e-12 THEN 'regressed' ELSE 'tied' END"
_N = r"trim(regexp_replace(lower({0}), '[\s\x{{a0}}]+', ' ', 'g'))"
_PAIR = f"""{_S}, t AS (SELECT coalesce(x.run_tag, y.run_tag) AS run_tag, coalesce(x.question_id, y.question_id) AS question_id,
  CASE WHEN x.status = 'ok' AND y.status = 'ok' AND x.prediction IS NOT NULL AND y.prediction IS NOT NULL THEN {_N.format('x.prediction')} = {_N.format('y.prediction')} END AS same
  FROM (SELECT * FROM s WHERE system = '{BASE}') x FULL JOIN (SELECT * FROM s WHERE system = '{OTHER}') y ON x.run_tag = y.run_tag AND x.question_id = y.question_id
  UNION ALL SELECT run_tag, question_id, NULL FROM w WHERE a IS NULL AND b IS NULL)"""
SQL = {
    "paired_runs": f"""{_S} SELECT run_tag, count_if(delta > 1e-12)::BIGINT AS improved, count_if(delta < -1e-12)::BIGINT AS regressed, count_if(abs(delta) <= 1e-12)::BIGINT AS tied,
  round(sum(CASE WHEN delta > 1e-12 THEN delta ELSE 0 END), 6) AS sum_gain, round(sum(CASE WHEN delta < -1e-12 THEN delta ELSE 0 END), 6) AS sum_loss, round(avg(delta), 6) AS mean_delta
  FROM p GROUP BY 1""",
    "paired_ok_only": f"""{_S}, o AS (SELECT run_tag, question_id, max(score) FILTER (system = '{BASE}') AS a, max(score) FILTER (system = '{OTHER}') AS b FROM s WHERE status = 'ok' GROUP BY 1, 2)
  SELECT {_V.format('(b - a)')} AS verdict, count(*) AS n FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
    "three_way": f"{_S} SELECT {_V.format('(b - a)')} AS first, {_V.format('(c - a)')} AS second, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2",
    "answers_agree": f"{_PAIR} SELECT run_tag, same AS agrees, count(*) AS n FROM t GROUP BY 1, 2",
    "delta_to_base": f"""{_S}, m AS (SELECT run_tag, system, avg(score) AS score, avg(exact) AS exact FROM s GROUP BY 1, 2)
  SELECT run_tag, system, round(score, 6) AS score, round(exact, 6) AS exact, round(score - max(score) FILTER (system = '{BASE}') OVER (PARTITION BY run_tag), 6) AS delta FROM m""",
    "wide_predictions": f"{_S} SELECT run_tag, question_id, " + ", ".join(f"max(coalesce(prediction, '(missing)')) FILTER (system = '{n}') AS pred_{n}, max(score) FILTER (system = '{n}') AS score_{n}" for n in (BASE, OTHER, THIRD)) + " FROM s GROUP BY 1, 2",
    "best_run": f"{_S} SELECT run_tag, round(avg(score), 6) AS score FROM s WHERE system = '{OTHER}' GROUP BY 1 ORDER BY score DESC, run_tag LIMIT 1",
    "top_gains": f"{_S} SELECT run_tag, question_id, round(delta, 6) AS delta FROM p ORDER BY 3 DESC, 1, 2 LIMIT 10",
    "top_changes": f"{_S} SELECT run_tag, question_id, round(delta, 6) AS delta FROM p ORDER BY abs(round(delta, 6)) DESC, 1 DESC, 2 DESC LIMIT 3",
    "gains_then_losses": f"""{_S}, r AS (SELECT run_tag, question_id, round(delta, 6) AS delta, CASE WHEN delta > 0 THEN 1 ELSE 2 END AS section FROM p WHERE abs(round(delta, 6)) > 1e-12)
  SELECT *, row_number() OVER (PARTITION BY run_tag, section ORDER BY abs(delta) DESC, question_id)::INT AS place FROM r QUALIFY place <= 20""",
    "gallery_picks": f"""{_S}, k AS (SELECT *, run_tag || '/' || lpad(question_id::VARCHAR, 12, '0') AS key FROM s)
  SELECT system, min(key) FILTER (exact = 1) AS first_exact, min(key) FILTER (score = 0 AND {_N.format("coalesce(prediction, '')")} <> '') AS first_error, min((score, key))[2] AS lowest FROM k GROUP BY 1""",
    "ranked_fill": f"""{_PAIR}, r AS (SELECT run_tag, question_id, CASE WHEN NOT same THEN 0 WHEN same THEN 1 ELSE 2 END AS rank FROM t)
  SELECT *, row_number() OVER (PARTITION BY run_tag ORDER BY rank, question_id)::INT AS place FROM r QUALIFY place <= 4""",
    "not_perfect": """SELECT run_tag, system, count(DISTINCT record_id) AS n FROM holdout_predictions
  WHERE status = 'ok' AND NOT coalesce(metrics.exact_match >= 1 - 1e-12 AND (metrics.anls_normalized_strict_v2 IS NULL OR metrics.anls_normalized_strict_v2 >= 1 - 1e-12), false) GROUP BY 1, 2""",
}
_ALL = _S.replace(f" AND system IN ('{BASE}', '{OTHER}', '{THIRD}')", "")
SQL |= {f"{name}_all": SQL[name].replace(_S, _ALL) for name in ("delta_to_base", "gallery_picks")}
SQL["wide_predictions_all"] = rf"""{_ALL} SELECT run_tag, question_id, COLUMNS('^(.*)_pred$') AS 'pred_\1', COLUMNS('^(.*)_score$') AS 'score_\1'
  FROM (PIVOT (SELECT run_tag, question_id, system, prediction, score FROM s) ON system USING max(coalesce(prediction, '(missing)')) AS pred, max(score) AS score GROUP BY run_tag, question_id)"""
