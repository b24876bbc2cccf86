"""Queries that sum up runs over what was required, and explain differences between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.functions import text
from docgauge.operators import stats
from docgauge.operators.compare import TIE, paired_conditions
from docgauge.operators.sampling import fill_categories
from docgauge.queries.comparison import _S, BASE, KEY, OTHER, _scores
from docgauge.queries.scoring import RUN, SCORED_SQL, scored_records
from docgauge.queries.statistics import latency_linear
from docgauge.session import table

SEED = 42
_METRICS = ("strict", "inclusive", "raw_length", "exact_match")


def _required(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest_examples").select("question_id").where(F.col("question_id").isNotNull()).distinct()


def requested_means(spark: SparkSession, folder: str) -> DataFrame:
    """Every score of a run over all required questions, missing and failed ones as 0, and over ok records alone."""
    n = _required(spark, folder).agg(F.count(F.lit(1))).scalar()
    sums = [(F.sum(f"m.{k}") / F.max(n)).alias(k) for k in _METRICS] + [F.avg(F.when(F.col("m.scored"), F.col(f"m.{k}"))).alias(f"ok_{k}") for k in _METRICS]
    rows = scored_records(spark, folder).groupBy(*RUN).agg(*sums)
    return rows.withColumns({k: F.round(k, 6) for k in rows.columns if k not in RUN})


def paired_required(spark: SparkSession, folder: str) -> DataFrame:
    """The base and the adapted system of each run over all required questions; what neither has is a tie at 0."""
    required = _required(spark, folder)
    n = required.agg(F.count(F.lit(1))).scalar()
    rows = _scores(spark, folder).join(required, "question_id", "left_semi")
    both = paired_conditions(rows, KEY, "system", [BASE, OTHER], F.col("score"))
    delta = F.coalesce(OTHER, F.lit(0.0)) - F.coalesce(BASE, F.lit(0.0))
    counts = both.groupBy("run_tag").agg(F.max(n).alias("n_required"), F.count_if(delta > TIE).alias("improved"), F.count_if(delta < -TIE).alias("regressed"), stats.exact_sum(delta).alias("sum"))
    return counts.select("run_tag", "n_required", "improved", "regressed", (F.col("n_required") - F.col("improved") - F.col("regressed")).alias("tied"), F.round(F.col("sum") / F.col("n_required"), 6).alias("mean_delta"))


def run_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The full table of a run: scores, matches but for a full stop, cap flags that are there or not, latency."""
    scored = scored_records(spark, folder, ["generation_cap_reached"])
    loose = text.exact_without_period(F.col("prediction"), F.col("references"))
    good = F.col("m.scored")
    rows = scored.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_ok"), F.round(F.avg("m.strict"), 6).alias("strict"), F.count_if(F.col("m.exact_match") == 1).alias("exact"),
        F.count_if(good & (loose == 1)).alias("loose"), F.count("generation_cap_reached").alias("caps_known"), F.count_if(F.col("generation_cap_reached").isNull()).alias("caps_unknown"),
    )
    return rows.join(latency_linear(spark, folder).select(*RUN, "median", "p95"), RUN, "left")


def cap_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each system and tile cap: failures, tiles, tokens, cap hits; the median is of nearest rank."""
    keys = ["system", "max_num"]
    rows = table(spark, folder, "holdout_predictions").select("system", F.col("image_info.max_num").alias("max_num"), F.col("image_info.tile_count").alias("tiles"), "status", "generated_token_length", "generation_cap_reached")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failed"), F.round(F.avg("tiles"), 6).alias("mean_tiles"),
        F.round(F.avg("generated_token_length"), 6).alias("mean_tokens"), F.count_if("generation_cap_reached").alias("cap_hits"),
    )
    middle = stats.percentiles_nearest(rows, keys, "generated_token_length", {"median_tokens": 0.5})
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return sums.alias("s").join(middle.alias("m"), same, "left").select("s.*", "m.median_tokens")


def reconciled_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Published medians and 95th percentiles of whole runs against those of the log, within 1e-9."""
    exact = latency_linear(spark, folder).select(*RUN, "median", "p95")
    rows = table(spark, folder, "holdout_final_analysis").where(F.col("eval_day").isNull()).join(exact, RUN, "left")

    def state(published: str, own: str) -> Column:
        gap = F.abs(F.col(published) - F.col(own))
        return F.when(F.col(published).isNull(), "absent").when(F.col(own).isNull(), "unknown").when(gap <= 1e-8, "equal").otherwise("off")

    both = F.array(F.struct(F.lit("median").alias("measure"), state("latency_generation_only_median", "median").alias("state")), F.struct(F.lit("p95").alias("measure"), state("latency_generation_only_p95_s", "p95").alias("state")))
    return rows.select(F.explode(both).alias("x")).groupBy("x.measure", "x.state").agg(F.count(F.lit(1)).alias("n"))


def previous_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Each run against the run before it: same texts, same scores, questions that run did not have."""
    rows = _scores(spark, folder, named=False)
    order = rows.select("system", "run_tag").distinct().withColumn("before", F.lag("run_tag").over(Window.partitionBy("system").orderBy("run_tag")))
    now = rows.join(order.where(F.col("before").isNotNull()), ["system", "run_tag"])
    old = rows.select("system", F.col("run_tag").alias("before"), "question_id", F.col("prediction").alias("old"), F.col("score").alias("old_score"), F.lit(True).alias("there"))
    both = now.join(old, ["system", "before", "question_id"], "left")
    there = F.col("there").isNotNull()
    return both.groupBy("system", "run_tag").agg(
        F.count(F.lit(1)).alias("n_compared"), F.count_if(there & F.col("prediction").eqNullSafe(F.col("old"))).alias("same_text"),
        F.count_if(there & (F.abs(F.col("score") - F.col("old_score")) <= TIE)).alias("same_score"), F.count_if(~there).alias("n_missing"),
    )


def _both(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of a run with a record of the base and of the adapted system."""
    wide = _scores(spark, folder).groupBy(*KEY).agg(*[F.max(F.when(F.col("system") == s, F.struct("score", "prediction"))).alias(k) for k, s in (("a", BASE), ("b", OTHER))])
    wide = wide.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return wide.select(*KEY, F.round(F.col("b.score") - F.col("a.score"), 12).alias("delta"), F.col("a.prediction").alias("old"), F.col("b.prediction").alias("new"))


def category_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each run the question that gained most, that lost most, and the first that stayed as it was; ties to the smallest."""
    same = text.strip(F.coalesce("old", F.lit(""))) == text.strip(F.coalesce("new", F.lit("")))
    rows = _both(spark, folder)
    best = lambda c, sign: F.min(F.when(c, F.struct((sign * F.col("delta")).alias("d"), "question_id")))
    found = rows.groupBy("run_tag").agg(best(F.col("delta") > TIE, -1).alias("up"), best(F.col("delta") < -TIE, 1).alias("down"), F.min(F.when((F.abs("delta") <= TIE) & same, F.col("question_id"))).alias("unchanged"))
    return found.select("run_tag", F.col("up.question_id").alias("improved"), (-F.col("up.d")).alias("gain"), F.col("down.question_id").alias("regressed"), F.col("down.d").alias("loss"), "unchanged")


def category_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Four questions of each run without repeats: a regression, an unchanged one, then changed answers, then any."""
    rows = _both(spark, folder)
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    return fill_categories(rows, "run_tag", "question_id", {"regression": F.col("delta") < -TIE}, {"unchanged": F.abs("delta") <= TIE}, {"prediction_change": changed}, 4, SEED)


def gap_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Whether final full stops explain the whole gap in exact matches between the two systems of a run."""
    scored = scored_records(spark, folder).where(F.col("m.scored") & F.col("system").isin(BASE, OTHER))
    loose = text.exact_without_period(F.col("prediction"), F.col("references")) == 1
    strict = F.col("m.exact_match") == 1
    of = lambda s, c: F.count_if((F.col("system") == s) & c)
    rows = scored.groupBy("run_tag").agg((of(BASE, strict) - of(OTHER, strict)).alias("primary_gap"), (of(BASE, loose) - of(OTHER, loose)).alias("loose_gap"), of(OTHER, loose & ~strict).alias("newly_matched"))
    return rows.withColumn("explained", (F.col("loose_gap") == 0) & (F.col("newly_matched") >= F.col("primary_gap")))


def metric_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """The stored score where null stays null, where null is 0, and where the exact match stands in for it; a score of 0 is a score."""
    m = F.col("metrics.anls_normalized_strict_v2")
    rows = table(spark, folder, "holdout_predictions").groupBy("system").agg(
        F.count(m).alias("n_scored"), F.avg(m).alias("nullable"), F.avg(F.coalesce(m, F.lit(0.0))).alias("defaulted"),
        F.avg(F.coalesce(m, F.col("metrics.exact_match"))).alias("fallback"), F.count_if(F.coalesce(m, F.lit(-1.0)) == 0).alias("zeros"),
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("nullable", "defaulted", "fallback")})


QUERIES = {f.__name__: f for f in (requested_means, paired_required, run_scores, cap_summary, reconciled_latency, previous_agreement, category_extremes, category_fill, gap_attribution, metric_defaults)}

_N = "n AS (SELECT count(DISTINCT question_id) AS n FROM manifest_examples)"
_LATENCY = """lat AS (SELECT run_tag, system, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.95), 9) AS p95 FROM (
  SELECT min(run_tag) AS run_tag, min(system) AS system, min(generation_seconds) AS x FROM holdout_predictions
  WHERE status = 'ok' AND NOT is_warmup AND generation_seconds > 0 AND isfinite(generation_seconds) GROUP BY record_id) GROUP BY 1, 2)"""
_ALL = _S.replace(f" AND system IN ('{BASE}', '{OTHER}', 'glyphvl_1b_lora_b')", "")
_BOTH = f"""{_S}, z AS (SELECT x.run_tag, x.question_id, round(y.score - x.score, 12) AS delta, x.prediction AS old, y.prediction AS new
  FROM s x JOIN s y ON x.run_tag = y.run_tag AND x.question_id = y.question_id AND x.system = '{BASE}' AND y.system = '{OTHER}')"""
_STRIP = r"regexp_replace(coalesce({0}, ''), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
SQL = {
    "requested_means": f"""{SCORED_SQL}, {_N} SELECT run_tag, system, {', '.join(f'round(sum({k}) / max(n), 6) AS {k}' for k in _METRICS)},
  {', '.join(f'round(avg({k}) FILTER (good), 6) AS ok_{k}' for k in _METRICS)} FROM scored, n GROUP BY run_tag, system""",
    "paired_required": f"""{_S}, {_N} SELECT run_tag, max(n) AS n_required, count_if(delta > 1e-12)::BIGINT AS improved, count_if(delta < -1e-12)::BIGINT AS regressed,
  (max(n) - count_if(delta > 1e-12) - count_if(delta < -1e-12))::BIGINT AS tied, round(sum(delta) / max(n), 6) AS mean_delta FROM p, n WHERE question_id IN (SELECT question_id FROM manifest_examples) GROUP BY 1""",
    "run_scores": f"""{SCORED_SQL}, {_LATENCY}, t AS (SELECT run_tag, system, count(*) AS n, count_if(good)::BIGINT AS n_ok, round(avg(strict), 6) AS strict, count_if(exact_match = 1)::BIGINT AS exact,
  count_if(good AND loose = 1)::BIGINT AS loose, count(generation_cap_reached) AS caps_known, count_if(generation_cap_reached IS NULL)::BIGINT AS caps_unknown FROM scored GROUP BY 1, 2)
SELECT t.*, median, p95 FROM t LEFT JOIN lat USING (run_tag, system)""",
    "cap_summary": """WITH l AS (SELECT system, image_info.max_num AS max_num, image_info.tile_count AS tiles, status, generated_token_length AS len, generation_cap_reached AS cap FROM holdout_predictions),
r AS (SELECT system, max_num, len, row_number() OVER (PARTITION BY system, max_num ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY system, max_num) AS n FROM l WHERE len IS NOT NULL),
m AS (SELECT system, max_num, max(len) FILTER (i = round_even(0.5 * (n - 1), 0)) AS median_tokens FROM r GROUP BY 1, 2),
t AS (SELECT system, max_num, count(*) AS n, count_if(status <> 'ok')::BIGINT AS failed, round(avg(tiles), 6) AS mean_tiles, round(avg(len), 6) AS mean_tokens, count_if(cap)::BIGINT AS cap_hits FROM l GROUP BY 1, 2)
SELECT t.*, median_tokens FROM t LEFT JOIN m ON t.system IS NOT DISTINCT FROM m.system AND t.max_num IS NOT DISTINCT FROM m.max_num""",
    "reconciled_latency": f"""WITH {_LATENCY}, b AS (SELECT latency_generation_only_median AS a, latency_generation_only_p95_s AS b, median, p95 FROM holdout_final_analysis LEFT JOIN lat USING (run_tag, system) WHERE eval_day IS NULL),
u AS (SELECT 'median' AS measure, a AS x, median AS y FROM b UNION ALL SELECT 'p95', b, p95 FROM b)
SELECT measure, CASE WHEN x IS NULL THEN 'absent' WHEN y IS NULL THEN 'unknown' WHEN abs(x - y) <= 1e-8 THEN 'equal' ELSE 'off' END AS state, count(*) AS n FROM u GROUP BY 1, 2""",
    "previous_agreement": f"""{_ALL}, o AS (SELECT system, run_tag, lag(run_tag) OVER (PARTITION BY system ORDER BY run_tag) AS before FROM (SELECT DISTINCT system, run_tag FROM s))
SELECT x.system, x.run_tag, count(*) AS n_compared, count_if(y.question_id IS NOT NULL AND x.prediction IS NOT DISTINCT FROM y.prediction)::BIGINT AS same_text,
  count_if(y.question_id IS NOT NULL AND abs(x.score - y.score) <= 1e-12)::BIGINT AS same_score, count_if(y.question_id IS NULL)::BIGINT AS n_missing
FROM s x JOIN o ON o.system = x.system AND o.run_tag = x.run_tag AND before IS NOT NULL LEFT JOIN s y ON y.system = x.system AND y.run_tag = before AND y.question_id = x.question_id GROUP BY 1, 2""",
    "category_extremes": f"""{_BOTH}, e AS (SELECT run_tag, min((-delta, question_id)) FILTER (delta > 1e-12) AS up, min((delta, question_id)) FILTER (delta < -1e-12) AS down,
  min(question_id) FILTER (abs(delta) <= 1e-12 AND {_STRIP.format('old')} = {_STRIP.format('new')}) AS unchanged FROM z GROUP BY 1)
SELECT run_tag, up[2] AS improved, -up[1] AS gain, down[2] AS regressed, down[1] AS loss, unchanged FROM e""",
    "category_fill": f"""{_BOTH}, h AS (SELECT *, sha256('{SEED}:' || question_id) AS h FROM z),
f AS (SELECT run_tag, min(question_id) FILTER (delta < -1e-12) AS first, min((h, question_id)) FILTER (abs(delta) <= 1e-12) AS second FROM h GROUP BY 1),
k AS (SELECT run_tag, question_id, CASE WHEN question_id = first THEN 0 WHEN question_id = second[2] THEN 1 WHEN old IS DISTINCT FROM new THEN 2 ELSE 3 END AS rank FROM z JOIN f USING (run_tag))
SELECT run_tag, question_id, CASE rank WHEN 0 THEN 'regression' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'prediction_change' ELSE 'fill' END AS category,
  row_number() OVER (PARTITION BY run_tag ORDER BY rank, question_id)::INT AS place FROM k QUALIFY place <= 4""",
    "gap_attribution": f"""{SCORED_SQL}, g AS (SELECT run_tag, count_if(system = '{BASE}' AND exact_match = 1) - count_if(system = '{OTHER}' AND exact_match = 1) AS primary_gap,
  count_if(system = '{BASE}' AND loose = 1) - count_if(system = '{OTHER}' AND loose = 1) AS loose_gap, count_if(system = '{OTHER}' AND loose = 1 AND exact_match = 0) AS newly_matched
  FROM scored WHERE good AND system IN ('{BASE}', '{OTHER}') GROUP BY 1)
SELECT run_tag, primary_gap::BIGINT AS primary_gap, loose_gap::BIGINT AS loose_gap, newly_matched::BIGINT AS newly_matched, loose_gap = 0 AND newly_matched >= primary_gap AS explained FROM g""",
    "metric_defaults": """WITH l AS (SELECT system, metrics.anls_normalized_strict_v2 AS m, metrics.exact_match AS e FROM holdout_predictions)
SELECT system, count(m) AS n_scored, round(avg(m), 6) AS nullable, round(avg(coalesce(m, 0)), 6) AS defaulted, round(avg(coalesce(m, e)), 6) AS fallback, count_if(m = 0)::BIGINT AS zeros FROM l GROUP BY 1""",
}
