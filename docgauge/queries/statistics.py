"""Queries on latencies, histograms, trends and published summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators import stats
from docgauge.session import cut, table

RUN = ["run_tag", "system"]


def _seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Positive finite times of ok records that are no warm-up, once per record."""
    log = table(spark, folder, "holdout_predictions")
    s = F.col("generation_seconds")
    good = log.where((F.col("status") == "ok") & ~F.col("is_warmup") & (s > 0) & ~F.isnan(s) & (s < float("inf")))
    return good.groupBy("record_id").agg(*[F.min(c).alias(c) for c in ("run_tag", "system", "eval_day", "generation_seconds", "generated_token_length")])


def latency_linear(spark: SparkSession, folder: str) -> DataFrame:
    seconds = cut(_seconds(spark, folder))  # read three times
    places = stats.percentiles_linear(seconds, RUN, "generation_seconds", {"median": 0.5, "p95": 0.95})
    rows = seconds.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.avg("generation_seconds").alias("mean"), F.max("generation_seconds").alias("longest")).join(places, RUN)
    # times have 6 decimals, so at 9 no interpolated value is a tie
    return rows.withColumns({c: F.round(c, 9) for c in ("median", "p95")} | {c: F.round(c, 6) for c in ("mean", "longest")})


def latency_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return stats.percentiles_nearest(_seconds(spark, folder), ["system"], "generation_seconds", {"median": 0.5, "p95": 0.95})


def tile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "holdout_predictions").select("system", F.col("image_info.tile_count").alias("tile_count"))
    return stats.histogram(rows, ["system"], "tile_count")


def error_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(table(spark, folder, "holdout_predictions").where(F.col("status") != "ok"), ["system"], "error")


def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per system: counts, scores with failures as 0, tokens, tiles."""
    log = table(spark, folder, "holdout_predictions").where(~F.col("is_warmup"))
    once = log.groupBy("record_id").agg(*[F.min(c).alias(c) for c in ("system", "status", "generated_token_length", "generation_cap_reached")], F.min("metrics.anls_normalized_strict_v2").alias("score"), F.min("metrics.exact_match").alias("exact"), F.min("image_info.tile_count").alias("tiles"), F.min("image_info.visual_token_count").alias("visual_tokens"))
    ok = F.col("status") == "ok"
    rows = once.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0))).alias("score"),
        F.avg(F.when(ok, F.coalesce("exact", F.lit(0.0))).otherwise(F.lit(0.0))).alias("exact"), F.count("generation_cap_reached").alias("flags"),
        F.count_if("generation_cap_reached").alias("cap_hits"), F.avg("generated_token_length").alias("tokens"), F.avg("tiles").alias("tiles"), F.avg("visual_tokens").alias("visual_tokens"),
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "exact", "tokens", "tiles", "visual_tokens")})


def uneven_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of a run whose systems saw different tile counts, or none."""
    rows = table(spark, folder, "holdout_predictions").groupBy("run_tag", "question_id").agg(F.count_distinct("image_info.tile_count").alias("kinds"), F.min("image_info.tile_count").alias("least"))
    return rows.where((F.col("kinds") != 1) | (F.col("least") < 1))


def seed_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of a system's published medians over its runs."""
    runs = table(spark, folder, "holdout_final_analysis").where(F.col("eval_day").isNull())
    return runs.groupBy("system").agg(*stats.spread(F.col("latency_generation_only_median"))).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "least", "greatest")})


def _series(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "holdout_final_analysis").where(F.col("latency_generation_only_median").isNotNull())
    return rows.select("system", "analysis_id", "run_tag", F.col("latency_generation_only_median").alias("x"))


def trailing_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.trailing_mean(_series(spark, folder), ["system"], ["analysis_id"], "x", "trailing")
    return rows.select("system", "analysis_id", F.round("trailing", 6).alias("trailing"))


def first_last_means(spark: SparkSession, folder: str) -> DataFrame:
    return stats.end_means(_series(spark, folder), ["system"], ["analysis_id"], "x").withColumns({c: F.round(c, 6) for c in ("first_mean", "last_mean")})


def window_means(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tumbling_mean(_series(spark, folder), ["system"], ["analysis_id"], "x").withColumn("mean", F.round("mean", 6))


def seen_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.seen_so_far(["system"], ["analysis_id"], "run_tag", _series(spark, folder))
    return rows.select("system", "analysis_id", "samples_seen", "unique_seen")


def step_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the question list is numbered without gaps, by shard."""
    rows = table(spark, folder, "manifest_examples").withColumn("step", F.col("example_index") + 1)
    whole = rows.agg(F.lit("all").alias("part"), stats.is_contiguous(F.col("step")).alias("contiguous"), F.count(F.lit(1)).alias("n"))
    return whole.unionByName(rows.groupBy(F.coalesce("source_shard", F.lit("")).alias("part")).agg(stats.is_contiguous(F.col("step")).alias("contiguous"), F.count(F.lit(1)).alias("n")))


def summary_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Published counts of a system's day that the log does not bear out."""
    rows = table(spark, folder, "holdout_predictions").groupBy(*RUN, "eval_day").agg(
        F.count_distinct("record_id").alias("rows"), F.count_distinct(F.when(F.col("status") == "ok", F.col("record_id"))).alias("ok"),
        F.count_distinct(F.when(F.col("status") != "ok", F.col("record_id"))).alias("failed"),
    )
    published = table(spark, folder, "holdout_final_analysis").where(F.col("eval_day").isNotNull()).select("analysis_id", *RUN, "eval_day", "n_requested", "n_ok", "n_failed")
    both = published.join(rows, [*RUN, "eval_day"], "left").na.fill(0, ["rows", "ok", "failed"])
    off = F.array_compact(F.array(F.when(F.col("n_requested") != F.col("rows"), "n_requested"), F.when(F.col("n_ok") != F.col("ok"), "n_ok"), F.when(F.col("n_failed") != F.col("failed"), "n_failed")))
    return both.select("analysis_id", F.explode(off).alias("field"))


def group_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_examples").groupBy("source_shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_answers").alias("least_answers"), F.max("n_answers").alias("most_answers"), F.avg("n_answers").alias("mean_answers"),
        F.min(F.length("question")).cast("long").alias("shortest"), F.max(F.length("question")).cast("long").alias("longest"), F.count_distinct("doc_id").alias("docs"),
    )
    return rows.withColumn("mean_answers", F.round("mean_answers", 6))


def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of documents by language and source, with subtotals."""
    docs = table(spark, folder, "documents").select(F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    rows = docs.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return rows


QUERIES = {
    f.__name__: f
    for f in (
        latency_linear, latency_nearest, tile_histogram, error_histogram, run_table, uneven_tiles, seed_summary, trailing_means,
        first_last_means, window_means, seen_runs, step_gaps, summary_reconciliation, group_metadata, event_rollup,
    )
}

_G = """WITH g AS (SELECT record_id, min(run_tag) AS run_tag, min(system) AS system, min(generation_seconds) AS x FROM holdout_predictions
  WHERE status = 'ok' AND NOT is_warmup AND generation_seconds > 0 AND isfinite(generation_seconds) GROUP BY 1)"""
_X = "WITH x AS (SELECT system, analysis_id, run_tag, latency_generation_only_median AS x FROM holdout_final_analysis WHERE latency_generation_only_median IS NOT NULL)"
SQL = {
    "latency_linear": f"""{_G} SELECT run_tag, system, count(*) AS n, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.95), 9) AS p95, round(avg(x), 6) AS mean, round(max(x), 6) AS longest FROM g GROUP BY 1, 2""",
    "latency_nearest": f"""{_G}, r AS (SELECT system, x, row_number() OVER (PARTITION BY system ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM g)
  SELECT system, max(x) FILTER (i = round_even(0.5 * (n - 1), 0)) AS median, max(x) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY 1""",
    "tile_histogram": "SELECT system, image_info.tile_count AS tile_count, count(*) AS n FROM holdout_predictions GROUP BY 1, 2",
    "error_histogram": "SELECT system, error, count(*) AS n FROM holdout_predictions WHERE status <> 'ok' GROUP BY 1, 2",
    "run_table": """WITH o AS (SELECT record_id, min(system) AS system, min(status) AS status, min(generated_token_length) AS len, min(generation_cap_reached) AS cap,
  min(metrics.anls_normalized_strict_v2) AS s, min(metrics.exact_match) AS e, min(image_info.tile_count) AS t, min(image_info.visual_token_count) AS v FROM holdout_predictions WHERE NOT is_warmup GROUP BY 1)
SELECT system, count(*) AS n, count_if(status = 'ok')::BIGINT AS n_ok, round(avg(CASE WHEN status = 'ok' THEN coalesce(s, 0) ELSE 0 END), 6) AS score, round(avg(CASE WHEN status = 'ok' THEN coalesce(e, 0) ELSE 0 END), 6) AS exact,
  count(cap) AS flags, count_if(cap)::BIGINT AS cap_hits, round(avg(len), 6) AS tokens, round(avg(t), 6) AS tiles, round(avg(v), 6) AS visual_tokens FROM o GROUP BY 1""",
    "uneven_tiles": """SELECT run_tag, question_id, count(DISTINCT image_info.tile_count) AS kinds, min(image_info.tile_count) AS least FROM holdout_predictions
  GROUP BY 1, 2 HAVING kinds <> 1 OR least < 1""",
    "seed_summary": """SELECT system, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS greatest
  FROM (SELECT system, latency_generation_only_median AS x FROM holdout_final_analysis WHERE eval_day IS NULL) GROUP BY 1""",
    "trailing_means": f"""{_X} SELECT system, analysis_id, round(CASE WHEN count(*) OVER w = 20 THEN avg(x) OVER w END, 6) AS trailing FROM x
  WINDOW w AS (PARTITION BY system ORDER BY analysis_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "first_last_means": f"""{_X}, r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY analysis_id) AS u, row_number() OVER (PARTITION BY system ORDER BY analysis_id DESC) AS d FROM x)
  SELECT system, round(CASE WHEN count(*) >= 20 THEN avg(x) FILTER (u <= 20) END, 6) AS first_mean, round(CASE WHEN count(*) >= 20 THEN avg(x) FILTER (d <= 20) END, 6) AS last_mean FROM r GROUP BY 1""",
    "window_means": f"""{_X}, r AS (SELECT *, ((row_number() OVER (PARTITION BY system ORDER BY analysis_id) - 1) // 8 + 1)::BIGINT AS step FROM x)
  SELECT system, step, round(avg(x), 6) AS mean, count(*) AS n FROM r GROUP BY 1, 2""",
    "seen_runs": f"""{_X}, f AS (SELECT *, (row_number() OVER (PARTITION BY system, run_tag ORDER BY analysis_id) = 1)::INT AS f FROM x)
  SELECT system, analysis_id, count(*) OVER w AS samples_seen, (sum(f) OVER w)::BIGINT AS unique_seen FROM f WINDOW w AS (PARTITION BY system ORDER BY analysis_id ROWS UNBOUNDED PRECEDING)""",
    "step_gaps": """WITH s AS (SELECT coalesce(source_shard, '') AS part, example_index + 1 AS i FROM manifest_examples)
  SELECT part, min(i) = 1 AND max(i) = count(*) AND count(DISTINCT i) = count(*) AS contiguous, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT 'all', i FROM s) GROUP BY 1""",
    "summary_reconciliation": """WITH l AS (SELECT run_tag, system, eval_day, count(DISTINCT record_id) AS n, count(DISTINCT record_id) FILTER (status = 'ok') AS k, count(DISTINCT record_id) FILTER (status <> 'ok') AS f FROM holdout_predictions GROUP BY ALL),
b AS (SELECT a.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(f, 0) AS f FROM holdout_final_analysis a LEFT JOIN l USING (run_tag, system, eval_day) WHERE a.eval_day IS NOT NULL)
SELECT analysis_id, 'n_requested' AS field FROM b WHERE n_requested <> n UNION ALL SELECT analysis_id, 'n_ok' FROM b WHERE n_ok <> k UNION ALL SELECT analysis_id, 'n_failed' FROM b WHERE n_failed <> f""",
    "group_metadata": """SELECT source_shard, count(*) AS n, min(n_answers) AS least_answers, max(n_answers) AS most_answers, round(avg(n_answers), 6) AS mean_answers,
  min(length(question)) AS shortest, max(length(question)) AS longest, count(DISTINCT doc_id) AS docs FROM manifest_examples GROUP BY 1""",
    "event_rollup": """SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT coalesce(lower(lang), '?') AS lang, coalesce(source, '?') AS source, n_chars FROM documents) GROUP BY ROLLUP (lang, source)""",
}
