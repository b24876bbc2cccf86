"""Queries on sampling, splits and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.digests import row_digest
from docgauge.functions.text import first_valid, optional_id
from docgauge.operators.digests import sequence_digest, set_digest
from docgauge.operators.leakage import blocked_groups, exclusion_reasons, group_key, overlap_counts
from docgauge.operators.skewed import SALT, lookup
from docgauge.operators.sampling import presented, spread_evenly, take_groups, take_per_group
from docgauge.session import table

SEED = 42


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_examples")
    key = group_key(optional_id(F.col("ucsf_document_id")), F.col("doc_id"), optional_id(F.col("ucsf_document_page_no")), F.col("source_image_sha256"))
    return rows.withColumn("group_id", F.concat_ws("|", key["kind"], key["k1"], F.coalesce(key["k2"], F.lit("")), F.coalesce(key["k3"], F.lit(""))))


def greedy_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document groups in shuffled order until a fifth of all questions is reached."""
    groups = _examples(spark, folder).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    target = table(spark, folder, "manifest_examples").agg(F.floor(F.count(F.lit(1)) * 0.2)).scalar()
    return take_groups(groups, "group_id", "n", target, SEED).select("group_id", "n", "before")


def per_group_sample(spark: SparkSession, folder: str) -> DataFrame:
    return take_per_group(_examples(spark, folder).select("group_id", "question_id"), "group_id", "question_id", 4, SEED)


def group_sample_report(spark: SparkSession, folder: str) -> DataFrame:
    """Available and selected members of each group, and which were selected."""
    taken = take_per_group(_examples(spark, folder).select("group_id", "question_id"), "group_id", "question_id", 4, SEED)
    sizes = _examples(spark, folder).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_available"))
    members = F.array_join(F.array_sort(F.collect_list("question_id")), ",")
    return sizes.join(taken.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_selected"), members.alias("members")), "group_id")


def even_sample(spark: SparkSession, folder: str) -> DataFrame:
    return spread_evenly(table(spark, folder, "manifest_examples").select("question_id"), "question_id", 8).select("slot", "question_id")


def cyclic_order(spark: SparkSession, folder: str) -> DataFrame:
    """The questions in order, two and a half times over."""
    return presented(table(spark, folder, "manifest_examples").select("question_id"), "question_id", 2.5)


def exclusion_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows by the first reason that keeps them from being used."""
    answers = table(spark, folder, "answer_sidecar").groupBy("question_id").agg(F.max(first_valid(F.col("answers")).isNotNull()).alias("answered"))
    rows = _examples(spark, folder).join(answers, "question_id", "left").withColumn("page_key", F.concat_ws("/", optional_id(F.col("ucsf_document_id")), optional_id(F.col("ucsf_document_page_no"))))
    rows = rows.withColumn("page_key", F.when(optional_id(F.col("ucsf_document_id")).isNotNull() & optional_id(F.col("ucsf_document_page_no")).isNotNull(), F.col("page_key")))
    sent = table(spark, folder, "internvl_error_sample_v1")
    pages = F.when(optional_id(F.col("ucsf_document_id")).isNotNull() & optional_id(F.col("ucsf_document_page_no")).isNotNull(), F.concat_ws("/", optional_id(F.col("ucsf_document_id")), optional_id(F.col("ucsf_document_page_no"))))
    failed = sent.where(F.col("exact_match") == 0)
    marked = exclusion_reasons(
        rows,
        {
            "no_valid_answer": ~F.coalesce("answered", F.lit(False)),
            "question": ("question_id", failed.select("question_id")),
            "page": ("page_key", failed.select(pages.alias("p"))),
            "image": ("source_image_sha256", rows.where(F.col("group_key_type") == "PAGE_FALLBACK").select("source_image_sha256")),
        },
    )
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def unblocked_groups(spark: SparkSession, folder: str) -> DataFrame:
    failed = table(spark, folder, "internvl_error_sample_v1").where(F.col("exact_match") == 0).select("question_id", F.lit(True).alias("failed")).distinct()
    rows = _examples(spark, folder).join(failed, "question_id", "left")
    return blocked_groups(rows, "group_id", F.coalesce("failed", F.lit(False)))


def overlap_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What the manifest shares with the delivered records."""
    manifest, sent = table(spark, folder, "manifest_examples"), table(spark, folder, "internvl_error_sample_v1")
    ucsf = optional_id(F.col("ucsf_document_id"))
    signals = {"question": F.col("question_id"), "ucsf": ucsf, "page": F.when(ucsf.isNotNull(), F.concat_ws("/", ucsf, optional_id(F.col("ucsf_document_page_no")))), "doc": F.col("doc_id"), "image": F.col("image_relpath"), "text": F.sha2(F.lower("question"), 256)}
    return overlap_counts(manifest, sent, signals)


def documents_with_many_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(ucsf, doc_id, docs): the ids of each document that has several, one row per id."""
    rows = table(spark, folder, "manifest_examples").select(optional_id(F.col("ucsf_document_id")).alias("ucsf"), "doc_id").where(F.col("ucsf").isNotNull()).distinct()
    several = rows.groupBy("ucsf").agg(F.count("doc_id").alias("docs")).where(F.col("docs") > 1)
    return lookup(rows, several, "ucsf", spread=["doc_id"], how="inner").drop(SALT)


def inconsistent_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a document that carry different images."""
    rows = table(spark, folder, "manifest_examples").groupBy("doc_id", "ucsf_document_page_no")
    return rows.agg(F.count_distinct("source_image_sha256").alias("images"), F.count(F.lit(1)).alias("n")).where(F.col("images") > 1)


def image_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the recorded image of an example is the source image, and what is missing."""
    png, source = F.col("image_sha256_png"), F.col("source_image_sha256")
    state = F.when(source.isNull() & png.isNull(), "missing").when(png == source, "ok").when(F.col("rgb_hash").isNull(), "unverified").otherwise("mismatch")
    return table(spark, folder, "manifest_examples").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each shard's questions: as a set, and in the order of the list."""
    rows = table(spark, folder, "manifest_examples").select(F.coalesce("source_shard", F.lit("")).alias("source_shard"), "question_id", "example_index")
    in_order = sequence_digest(rows, ["source_shard"], F.col("question_id"), F.col("example_index")).withColumnRenamed("digest", "in_order")
    return set_digest(rows, ["source_shard"], F.col("question_id")).withColumnRenamed("digest", "as_set").join(in_order, "source_shard")


def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose whole text occurs more than once, by digest."""
    docs = table(spark, folder, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > 1)


def row_digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_examples")
    return rows.select("question_id", row_digest(F.col("doc_id"), F.col("ucsf_document_id"), F.col("target_answer")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        greedy_groups, per_group_sample, group_sample_report, even_sample, cyclic_order, exclusion_cascade, unblocked_groups,
        overlap_audit, documents_with_many_ids, inconsistent_pages, image_status, digests, content_digests, row_digests,
    )
}



def chunked_sql(source: str, by: str, value: str, order: str) -> str:
    placed = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i FROM {source} WHERE {order} IS NOT NULL"
    level = f"SELECT {by}, i // 1024 AS c, sha256(string_agg({value}::VARCHAR, ',' ORDER BY i)) AS d FROM ({placed}) GROUP BY ALL"
    tops = f"SELECT {by}, c // 1024 AS t, sha256(string_agg(d, ',' ORDER BY c)) AS d FROM ({level}) GROUP BY ALL"
    return f"SELECT {by}, sha256(string_agg(d, ',' ORDER BY t)) AS digest FROM ({tops}) GROUP BY ALL"


_T = r"nullif(regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+$', '', 'g'), '')"
_U, _PG = _T.format("ucsf_document_id"), _T.format("ucsf_document_page_no")
_E = f"""WITH e AS (SELECT *, CASE WHEN {_U} IS NOT NULL THEN 'UCSF|' || {_U} || '||' ELSE 'PAGE_FALLBACK|' || doc_id || '|' || coalesce({_PG}, '') || '|' || coalesce(source_image_sha256, '') END AS group_id,
  CASE WHEN {_U} IS NOT NULL AND {_PG} IS NOT NULL THEN {_U} || '/' || {_PG} END AS page_key FROM manifest_examples)"""
_TAKE = f"{_E}, t AS (SELECT group_id, question_id FROM e QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sha256('{SEED}:' || question_id), question_id) <= 4)"
SQL = {
    "greedy_groups": f"""{_E}, g AS (SELECT group_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT group_id, n,
  (coalesce(sum(n) OVER (ORDER BY sha256('{SEED}:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM g)
  SELECT * FROM r WHERE before < (SELECT floor(count(*) * 0.2) FROM manifest_examples)""",
    "per_group_sample": f"{_TAKE} SELECT * FROM t",
    "group_sample_report": f"""{_TAKE}, s AS (SELECT group_id, count(*) AS n_available FROM e GROUP BY 1)
  SELECT group_id, max(n_available) AS n_available, count(*) AS n_selected, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) AS members FROM s JOIN t USING (group_id) GROUP BY 1""",
    "even_sample": """WITH r AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS i, count(*) OVER () AS n FROM manifest_examples)
  SELECT s::INT AS slot, question_id FROM r JOIN range(8) t(s) ON i = round_even(s * (n - 1) / 7.0, 0)""",
    "cyclic_order": """WITH r AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS i, count(*) OVER () AS n FROM manifest_examples)
  SELECT i + k * n AS step, question_id FROM r, range(3) t(k) WHERE i + k * n < floor(n * 2.5)""",
    "exclusion_cascade": f"""{_E}, f AS (SELECT question_id, CASE WHEN {_U} IS NOT NULL AND {_PG} IS NOT NULL THEN {_U} || '/' || {_PG} END AS page_key FROM internvl_error_sample_v1 WHERE exact_match = 0),
a AS (SELECT question_id FROM answer_sidecar WHERE len(list_filter(coalesce(answers, []), lambda r: {_T.format('r')} IS NOT NULL)) > 0),
r AS (SELECT CASE WHEN question_id NOT IN (SELECT question_id FROM a) THEN 'no_valid_answer' WHEN question_id IN (SELECT question_id FROM f) THEN 'question'
  WHEN page_key IN (SELECT page_key FROM f WHERE page_key IS NOT NULL) THEN 'page' WHEN source_image_sha256 IN (SELECT source_image_sha256 FROM e WHERE group_key_type = 'PAGE_FALLBACK' AND source_image_sha256 IS NOT NULL) THEN 'image' ELSE 'kept' END AS reason FROM e)
SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "unblocked_groups": f"""{_E} SELECT group_id, count(*) AS n FROM e GROUP BY 1 HAVING NOT bool_or(question_id IN (SELECT question_id FROM internvl_error_sample_v1 WHERE exact_match = 0 AND question_id IS NOT NULL))""",
    "overlap_audit": " UNION ALL ".join(
        f"SELECT '{k}' AS signal, count(*) AS shared FROM (SELECT {x} AS v FROM manifest_examples INTERSECT SELECT {x} FROM internvl_error_sample_v1) WHERE v IS NOT NULL"
        for k, x in {"question": "question_id", "ucsf": _U, "page": f"CASE WHEN {_U} IS NOT NULL THEN concat_ws('/', {_U}, {_PG}) END", "doc": "doc_id", "image": "image_relpath", "text": "sha256(lower(question))"}.items()
    ),
    "documents_with_many_ids": f"""WITH d AS (SELECT DISTINCT {_U} AS ucsf, doc_id FROM manifest_examples WHERE {_U} IS NOT NULL)
  SELECT ucsf, doc_id, count(doc_id) OVER (PARTITION BY ucsf) AS docs FROM d QUALIFY docs > 1""",
    "inconsistent_pages": "SELECT doc_id, ucsf_document_page_no, count(DISTINCT source_image_sha256) AS images, count(*) AS n FROM manifest_examples GROUP BY 1, 2 HAVING images > 1",
    "image_status": """SELECT CASE WHEN source_image_sha256 IS NULL AND image_sha256_png IS NULL THEN 'missing' WHEN image_sha256_png = source_image_sha256 THEN 'ok' WHEN rgb_hash IS NULL THEN 'unverified' ELSE 'mismatch' END AS state, count(*) AS n
  FROM manifest_examples GROUP BY 1""",
    "digests": f"""WITH m AS (SELECT coalesce(source_shard, '') AS source_shard, question_id, example_index FROM manifest_examples)
  SELECT source_shard, a.digest AS as_set, b.digest AS in_order FROM ({chunked_sql('(SELECT DISTINCT source_shard, question_id FROM m)', 'source_shard', 'question_id', 'question_id')}) a
  JOIN ({chunked_sql('m', 'source_shard', 'question_id', 'example_index')}) b USING (source_shard)""",
    "content_digests": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "row_digests": "SELECT question_id, sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(ucsf_document_id, chr(0)), coalesce(target_answer, chr(0)))) AS digest FROM manifest_examples",
}
