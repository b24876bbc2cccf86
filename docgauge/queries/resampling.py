"""Queries on resampling, neighbours and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.geometry import aspect_log, tile_count, tile_ratios, visual_tokens
from docgauge.operators.bootstrap import cluster_bootstrap
from docgauge.operators.digests import sequence_digest
from docgauge.operators.neighbors import nearest_donors
from docgauge.queries.comparison import _S, _paired
from docgauge.queries.selection import chunked_sql
from docgauge.session import table

REPLICATES, SEED = 2000, 42


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Paired scores with the question's document; unknown questions are groups of their own."""
    docs = table(spark, folder, "manifest_examples").select("question_id", F.col("doc_id").cast("string").alias("group"))
    rows = _paired(spark, folder).join(docs, "question_id", "left")
    return rows.withColumn("group", F.coalesce("group", F.concat(F.lit("MISSING::"), F.col("question_id").cast("string"))))


def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    result = cluster_bootstrap(_grouped(spark, folder), "group", "base", "other", replicates=REPLICATES, seed=SEED)
    return result.withColumns({c: F.round(c, 6) for c in ("observed", "mean", "low", "high")})


def paired_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each run's paired scores and of its groups: what an interval is bound to."""
    rows = _grouped(spark, folder)
    member = F.concat_ws(":", F.col("question_id").cast("string"), F.col("group"))
    score = F.concat_ws(":", member, F.format_number("base", 6), F.format_number("other", 6))
    scores = sequence_digest(rows, ["run_tag"], score, F.col("question_id")).withColumnRenamed("digest", "scores_digest")
    return scores.join(sequence_digest(rows, ["run_tag"], member, F.col("question_id")).withColumnRenamed("digest", "groups_digest"), "run_tag")


def nearest_parts(spark: SparkSession, folder: str) -> DataFrame:
    """For each part the part of another brand and type with the nearest aspect of size to price."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", aspect_log(F.col("p_size") * 40, F.col("p_retailprice")).alias("aspect"))
    found = nearest_donors(parts, "p_partkey", "aspect", ["p_brand", "p_type"])
    return found.select("p_partkey", "donor", F.round("distance", 6).alias("distance"))


def tile_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles and visual tokens of parts taken as images of size * 40 by price pixels."""
    parts = table(spark, folder, "part").select((F.col("p_size") * 40).alias("w"), F.greatest(F.lit(1), F.col("p_retailprice").cast("int")).alias("h"))
    tiles = tile_count(F.col("w"), F.col("h"), 12)
    return parts.groupBy(tiles.alias("tiles"), visual_tokens(tiles).alias("tokens")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (bootstrap_interval, paired_digests, nearest_parts, tile_distribution)}

_GROUPED = f"""{_S}, g AS (SELECT run_tag, p.question_id, coalesce(doc_id::VARCHAR, 'MISSING::' || p.question_id) AS grp, coalesce(a, 0.0) AS base, coalesce(b, 0.0) AS other, delta
  FROM p JOIN w USING (run_tag, question_id) LEFT JOIN manifest_examples m ON m.question_id = p.question_id)"""
_RATIOS = ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(tile_ratios(12)))
SQL = {
    "bootstrap_interval": f"""{_GROUPED}, sums AS (SELECT grp, sum(delta) AS gain, count(*) AS n, row_number() OVER (ORDER BY sha256(grp), grp) - 1 AS place FROM g GROUP BY 1),
k AS (SELECT count(*) AS k FROM sums),
d AS (SELECT r, ('0x' || substr(sha256('{SEED}:' || r || ':' || i), 1, 15))::BIGINT % (SELECT k FROM k) AS place FROM range({REPLICATES}) a(r), range((SELECT k FROM k)) b(i)),
m AS (SELECT r, sum(gain) / sum(n) AS mean FROM d JOIN sums USING (place) GROUP BY 1)
SELECT (SELECT round(sum(gain) / sum(n), 6) FROM sums) AS observed, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS replicates FROM m""",
    "paired_digests": f"""{_GROUPED}, v AS (SELECT run_tag, question_id, question_id || ':' || grp AS member, question_id || ':' || grp || ':' || printf('%.6f', base) || ':' || printf('%.6f', other) AS score FROM g)
  SELECT run_tag, a.digest AS scores_digest, b.digest AS groups_digest FROM ({chunked_sql('v', 'run_tag', 'score', 'question_id')}) a JOIN ({chunked_sql('v', 'run_tag', 'member', 'question_id')}) b USING (run_tag)""",
    "nearest_parts": """WITH a AS (SELECT p_partkey, p_brand, p_type, ln(greatest(p_size * 40, 1) / greatest(p_retailprice, 1)) AS v FROM part)
  SELECT q.p_partkey, (min((abs(q.v - d.v), d.p_partkey)))[2] AS donor, round((min((abs(q.v - d.v), d.p_partkey)))[1], 6) AS distance FROM a q JOIN a d ON q.p_brand <> d.p_brand AND q.p_type <> d.p_type GROUP BY 1""",
    "tile_distribution": f"""WITH RECURSIVE r(k, i, j) AS (VALUES {_RATIOS}), a AS (SELECT p_partkey, p_size * 40 AS w, greatest(1, trunc(p_retailprice)::INT) AS h FROM part),
f AS (SELECT p_partkey, w, h, -1 AS k, 1e308 AS gap, 1 AS i, 1 AS j FROM a UNION ALL
  SELECT f.p_partkey, f.w, f.h, r.k, CASE WHEN x THEN g ELSE f.gap END, CASE WHEN x THEN r.i ELSE f.i END, CASE WHEN x THEN r.j ELSE f.j END
  FROM (SELECT f.*, abs(f.w / f.h - r.i / r.j) AS g, abs(f.w / f.h - r.i / r.j) < f.gap OR (abs(f.w / f.h - r.i / r.j) = f.gap AND f.w::DOUBLE * f.h > 100352.0 * r.i * r.j) AS x, r.k AS rk FROM f JOIN r ON r.k = f.k + 1) f JOIN r ON r.k = f.rk),
t AS (SELECT CASE WHEN i * j > 1 THEN i * j + 1 ELSE 1 END AS tiles FROM f WHERE k = (SELECT max(k) FROM r))
SELECT tiles, tiles * 256 AS tokens, count(*) AS n FROM t GROUP BY 1, 2""",
}
