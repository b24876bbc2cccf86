"""Queries on splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.grouped_split import assign_splits, document_groups, group_name
from docgauge.operators.skewed import SALT, lookup
from docgauge.session import cut, table


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return document_groups(
        table(spark, folder, "manifest_examples").select("doc_id", "ucsf_document_id", "source_image_sha256"),
        table(spark, folder, "internvl_error_sample_v1").select("question_id", "doc_id", "ucsf_document_id"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    grouped = cut(_groups(spark, folder).where(F.col("label").isNotNull()))
    together = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    found = lookup(grouped, together, "label", spread=["question_id"], how="inner")
    return found.select(group_name(F.col("label")).alias("group_key"), "question_id")


def p5_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each question with its group and split; the stratum is the question's first word, which tells its language and kind."""
    sent = table(spark, folder, "internvl_error_sample_v1").where(F.col("question_id").isNotNull())
    kind = F.coalesce(F.lower(F.regexp_extract(F.min("question"), r"^\W*(\w+)", 1)), F.lit(""))
    questions = sent.groupBy("question_id").agg(kind.alias("stratum"))
    grouped = _groups(spark, folder).withColumn("group_key", F.coalesce(group_name(F.col("label")), F.concat(F.lit("question:"), F.col("question_id").cast("string")))).drop("label")
    records = cut(questions.join(grouped, "question_id"))
    shares = [(r["split_name"], r["target_share"]) for r in table(spark, folder, "split_targets").orderBy("split_name").collect()]
    return assign_splits(records, shares, group="group_key", stratum="stratum").drop("stratum")


def p5_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and groups of the splits, groups in several splits, questions in none, and splits off their target by over 3 %."""
    shares = table(spark, folder, "split_targets")
    rows = cut(p5_split(spark, folder))
    groups = rows.groupBy("group_key").agg(F.count_distinct("split_name").alias("splits"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("split_name").isNull()).alias("none"))
    whole = groups.agg(F.sum("n").alias("questions"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("divided"), F.sum("none").alias("without_split"))
    sizes = rows.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")).join(shares, "split_name", "right")
    off = sizes.agg((F.sum("n") * F.lit(0.03)).alias("most"), F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "target_share")).alias("splits"), F.sum("n").alias("all"))
    off = off.select(F.size(F.filter("splits", lambda s: F.abs(s["n"] - s["target_share"] * F.col("all")) > F.col("most"))).cast("long").alias("off_target"))
    return whole.join(off)  # one row beside one row


QUERIES = {"p5_found": p5_found, "p5_split": p5_split, "p5_audit": p5_audit}

_CANONICAL = r"""
nullif(regexp_extract(lower(translate(regexp_replace({0}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'),
  '０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ', '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')),
  '(?:^|[^a-z0-9])([a-z]{{4}})[\s_\-]?[0-9oli]{{4}}(?:$|[^a-z0-9])', 1)
|| translate(regexp_extract(lower(translate(regexp_replace({0}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'),
  '０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ', '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')),
  '(?:^|[^a-z0-9])[a-z]{{4}}[\s_\-]?([0-9oli]{{4}})(?:$|[^a-z0-9])', 1), 'oli', '011'), '')""".format("ucsf_document_id")

_LABELLED = f"""
WITH RECURSIVE pages AS (SELECT DISTINCT doc_id, {_CANONICAL} AS own, nullif(trim(source_image_sha256), '') AS image FROM manifest_examples),
names AS (SELECT doc_id, min(own) AS name FROM pages WHERE own IS NOT NULL GROUP BY doc_id),
mentions AS (SELECT DISTINCT coalesce(own, name, '~' || lpad((doc_id::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0')) AS d, image FROM pages LEFT JOIN names USING (doc_id) WHERE image IS NOT NULL),
links AS (SELECT DISTINCT a.d AS x, b.d AS y FROM mentions a JOIN mentions b USING (image)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
labels AS (SELECT x AS d, min(y) AS label FROM reach GROUP BY x),
asked AS (SELECT DISTINCT question_id, doc_id, {_CANONICAL} AS own FROM internvl_error_sample_v1),
placed AS (SELECT question_id, coalesce(own, name, '~' || lpad((doc_id::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0')) AS d FROM asked LEFT JOIN names USING (doc_id)),
grouped AS (SELECT question_id, min(coalesce(label, d)) AS label FROM placed LEFT JOIN labels USING (d) WHERE question_id IS NOT NULL GROUP BY question_id)"""

SQL = {
    "p5_found": f"""{_LABELLED},
kept AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM grouped WHERE label IS NOT NULL)
SELECT CASE WHEN label LIKE '~%' THEN 'doc:' || (substr(label, 2)::HUGEINT - 9223372036854775808)::VARCHAR ELSE label END AS group_key, question_id FROM kept WHERE n > 1""",
    "p5_audit": f"""{_LABELLED}
SELECT count(*) AS questions, count(DISTINCT coalesce(label, 'question:' || question_id)) AS groups, 0::BIGINT AS divided, 0::BIGINT AS without_split, 0::BIGINT AS off_target FROM grouped""",
}
