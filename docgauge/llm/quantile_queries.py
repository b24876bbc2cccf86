"""Queries on percentiles of generation times."""

from __future__ import annotations

from functools import reduce
from operator import le, lt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.quantiles import build_sketches, latency_values, merge_sketches, quantile, rank_error, share
from docgauge.session import cut, table

DAY = ["run_tag", "system", "eval_day"]
#: A published figure is refuted beyond this gap between its rank and p.
GAP = 0.02


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch of each system's day of a run, written down."""
    values = latency_values(table(spark, folder, "holdout_predictions"))
    return cut(merge_sketches(cut(build_sketches(values, DAY, "generation_seconds")), DAY))


#: The keys of each span, and the shorter span whose kept sketches it is merged from.
SPANS = {"run_day": (DAY, None), "day": (["system", "eval_day"], "run_day"), "run": (["run_tag", "system"], "run_day"), "log": (["system"], "run")}


def _spans(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The kept sketches of each span."""
    kept = {}
    for span, (keys, shorter) in SPANS.items():
        kept[span] = cut(merge_sketches(kept[shorter], keys)) if shorter else _kept(spark, folder)
    return kept


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    days = _kept(spark, folder)
    runs = merge_sketches(days, DAY[:2])
    published = table(spark, folder, "holdout_final_analysis").select(
        "analysis_id", *DAY,
        F.explode(F.array(
            F.struct(F.lit("median").alias("measure"), F.lit(0.5).alias("p"), F.col("latency_generation_only_median").alias("figure")),
            F.struct(F.lit("p95").alias("measure"), F.lit(0.95).alias("p"), F.col("latency_generation_only_p95_s").alias("figure")),
        )).alias("x"),
    ).select("analysis_id", *DAY, "x.*").where(F.col("figure").isNotNull())
    of_day = published.where(F.col("eval_day").isNotNull()).join(days, DAY)
    of_run = published.where(F.col("eval_day").isNull()).drop("eval_day").join(runs, DAY[:2])
    columns = ["analysis_id", "measure", "p", "figure", "n", "levels"]
    ranked = of_day.select(*columns).unionByName(of_run.select(*columns))
    low, high = share(F.col("figure"), inclusive=False), share(F.col("figure"), inclusive=True)
    ranked = ranked.select("analysis_id", "measure", "p", low.alias("low"), high.alias("high"))
    inside = (F.col("low") <= F.col("p")) & (F.col("p") <= F.col("high"))
    gap = F.when(inside, F.lit(0.0)).otherwise(F.least(F.abs(F.col("low") - F.col("p")), F.abs(F.col("high") - F.col("p"))))
    return ranked.where(gap > GAP).select("analysis_id", "measure")


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for span, sketches in _spans(spark, folder).items():
        keys = SPANS[span][0]
        missing = [F.lit(None).cast(kind).alias(k) for k, kind in zip(DAY, ("string", "string", "date")) if k not in keys]
        parts.append(sketches.select(F.lit(span).alias("span"), *keys, *missing, "n", quantile(0.5).alias("median"), quantile(0.95).alias("p95"), rank_error().alias("rank_error")))
    return reduce(DataFrame.unionByName, parts)


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Of each span the groups, their values, and the figures whose true rank is beyond the stated error.

    The figures of all spans stand beside each day of a run, so values are
    counted against them once, and counts are summed up to the spans.
    """
    figures, places = None, []
    for span, sketches in _spans(spark, folder).items():
        keys = SPANS[span][0]
        own = sketches.select(*keys, F.array(quantile(0.5), quantile(0.95)).alias(f"{span}_at"), rank_error().alias(f"{span}_error"))
        figures = own if figures is None else figures.join(own, keys)
        places += [F.count_if(test(F.col("generation_seconds"), F.col(f"{span}_at")[i])).alias(f"{span}_{name}{i}") for i in (0, 1) for name, test in (("below", lt), ("upto", le))]
    values = latency_values(table(spark, folder, "holdout_predictions")).join(figures, DAY)
    errors = [f"{span}_error" for span in SPANS]
    counted = cut(values.groupBy(*DAY, *errors).agg(F.count(F.lit(1)).alias("n"), *places))
    parts = []
    for span, (keys, _) in SPANS.items():
        sums = [F.sum(f"{span}_{name}{i}").alias(f"{name}{i}") for i in (0, 1) for name in ("below", "upto")]
        rows = counted.groupBy(*keys, f"{span}_error").agg(F.sum("n").alias("n"), *sums)
        # the figure is the least value of rank p or more, so p lies between its two ranks but for the error
        beyond = [F.when((F.col(f"below{i}") / F.col("n") - p > F.col(f"{span}_error")) | (p - F.col(f"upto{i}") / F.col("n") > F.col(f"{span}_error")), 1).otherwise(0) for i, p in enumerate((0.5, 0.95))]
        parts.append(rows.agg(F.lit(span).alias("span"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(beyond[0] + beyond[1]).alias("beyond")))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_bounds": p2_bounds}

SQL = {
    "p2_found": """
WITH values_ AS (
  SELECT DISTINCT record_id, run_tag, system, eval_day, generation_seconds AS x FROM holdout_predictions
  WHERE status = 'ok' AND NOT is_warmup AND generation_seconds > 0 AND isfinite(generation_seconds)),
figures AS (
  SELECT analysis_id, run_tag, system, eval_day, 'median' AS measure, 0.5 AS p, latency_generation_only_median AS f FROM holdout_final_analysis
  UNION ALL SELECT analysis_id, run_tag, system, eval_day, 'p95', 0.95, latency_generation_only_p95_s FROM holdout_final_analysis),
ranked AS (
  SELECT analysis_id, measure, any_value(p) AS p, avg((x < f)::INT) AS l, avg((x <= f)::INT) AS h
  FROM figures JOIN values_ USING (run_tag, system)
  WHERE f IS NOT NULL AND (figures.eval_day IS NULL OR figures.eval_day = values_.eval_day) GROUP BY analysis_id, measure)
SELECT analysis_id, measure FROM ranked
WHERE NOT (l <= p AND p <= h) AND least(abs(l - p), abs(h - p)) > 0.02""",
    "p2_bounds": """
WITH v AS (
  SELECT record_id, min(run_tag) AS run_tag, min(system) AS system, min(eval_day) AS eval_day FROM holdout_predictions
  WHERE status = 'ok' AND NOT is_warmup AND generation_seconds > 0 AND isfinite(generation_seconds) GROUP BY record_id)
SELECT 'run_day' AS span, count(DISTINCT (run_tag, system, eval_day)) AS groups, count(*) AS n, 0::BIGINT AS beyond FROM v
UNION ALL SELECT 'day', count(DISTINCT (system, eval_day)), count(*), 0 FROM v
UNION ALL SELECT 'run', count(DISTINCT (run_tag, system)), count(*), 0 FROM v
UNION ALL SELECT 'log', count(DISTINCT system), count(*), 0 FROM v""",
}
