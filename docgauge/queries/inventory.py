"""Queries on what is there: scans, sets, orders, files, requests and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import geometry
from docgauge.functions.digests import hashed
from docgauge.functions.text import optional_id, strip
from docgauge.functions.validation import refusal_reason
from docgauge.operators.coverage import set_difference
from docgauge.operators.digests import sequence_digest
from docgauge.operators.leakage import group_key
from docgauge.operators.numbering import numbered
from docgauge.operators.sampling import cut_rows, size_picks
from docgauge.plans.flows import audit_splits
from docgauge.queries.resampling import nearest_parts
from docgauge.queries.scoring import REFERENCES_SQL, references
from docgauge.queries.selection import _E, _T, SEED, chunked_sql, greedy_groups
from docgauge.sources.documents import late_columns, list_files, point_lookup, scan_shards, verify_files
from docgauge.session import table


def shard_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, questions and images of the shards of a table, and rows whose shard is not known."""
    rows = scan_shards(spark, f"{folder}/manifest_examples.parquet", ["question_id", "source_image_sha256"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question_id").alias("questions"), F.count_distinct("source_image_sha256").alias("images"), F.count_if(F.col("source_shard").isNull()).alias("without_shard"))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of the folder whose name starts with what is asked for, in order; none would raise."""
    return list_files(spark, folder, prefix="holdout_", suffix=".parquet")


def late_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the texts of documents without a source: texts are read for those alone."""
    wanted = table(spark, folder, "documents").where(F.col("source").isNull())
    return late_columns(spark, f"{folder}/documents.parquet", "doc_id", wanted, ["text"]).select("doc_id", F.sha2("text", 256).alias("digest"))


def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """The row of the largest question id, by a filter that reaches the scan."""
    path = f"{folder}/manifest_examples.parquet"
    key = spark.read.parquet(path).agg(F.max("question_id")).first()[0]
    return point_lookup(spark, path, "question_id", key, ["doc_id", "question"])


def verified_images(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the image that a delivered record names is one the manifest has, by digest."""
    files = table(spark, folder, "manifest_examples").groupBy(F.col("image_relpath").alias("path")).agg(F.min("image_sha256_png").alias("sha256"))
    expected = table(spark, folder, "manifest_examples").groupBy("question_id").agg(F.min("image_sha256_png").alias("png"), F.min("source_image_sha256").alias("source"))
    rows = table(spark, folder, "internvl_error_sample_v1").select("question_id", "image_relpath").join(expected, "question_id", "left")
    return verify_files(rows, files, "image_relpath", "png", "source").groupBy("file_state").agg(F.count(F.lit(1)).alias("n"))


def set_equality(spark: SparkSession, folder: str) -> DataFrame:
    """Whether two tables are of the same questions, and how many each has alone."""
    return set_difference(table(spark, folder, "manifest_examples"), table(spark, folder, "answer_sidecar"), "question_id")


def unioned_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest and sidecar under one another, columns by name; what one lacks is null."""
    a = table(spark, folder, "manifest_examples").select(F.lit("manifest").alias("origin"), "question_id", "doc_id", "target_answer")
    b = table(spark, folder, "answer_sidecar").select("target_answer", "target_selection_rule", F.lit("sidecar").alias("origin"), "question_id")
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_doc"), F.count("target_answer").alias("with_target"), F.count("target_selection_rule").alias("with_rule"))


def split_disjointness(spark: SparkSession, folder: str) -> DataFrame:
    """What the listed, the unlisted and the delivered questions share: a leak wherever it is not 0."""
    manifest, sent = table(spark, folder, "manifest_examples"), table(spark, folder, "internvl_error_sample_v1")
    splits = {"known": manifest.where(F.col("ucsf_document_id").isNotNull()), "unknown": manifest.where(F.col("ucsf_document_id").isNull()), "sent": sent}
    return audit_splits(splits, {"question": "question_id", "doc": "doc_id", "image": "image_relpath"})


def content_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered records whose image and question, but for white space, are those of a manifest row."""
    asked = strip(F.col("question")).alias("asked")
    known = table(spark, folder, "manifest_examples").select("image_relpath", asked, F.lit(True).alias("known")).distinct()
    sent = table(spark, folder, "internvl_error_sample_v1").select("image_relpath", asked)
    return sent.join(known, ["image_relpath", "asked"], "left").groupBy(F.col("known").isNotNull().alias("matched")).agg(F.count(F.lit(1)).alias("n"))


def enriched_presets(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered questions with whether their image has a digest and how many references they have."""
    presets = table(spark, folder, "internvl_error_sample_v1").select("question_id").where(F.col("question_id").isNotNull()).distinct()
    images = table(spark, folder, "manifest_examples").groupBy("question_id").agg(F.min("image_sha256_png").alias("sha256"))
    rows = presets.join(images, "question_id", "left").join(references(spark, folder), "question_id", "left")
    return rows.select("question_id", F.col("sha256").isNotNull().alias("has_image"), F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("n_references"))


def manifest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first four examples: the smoke run."""
    return table(spark, folder, "manifest_examples").select("example_index", "question_id").orderBy("example_index").limit(4)


def tagged_order(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of documents and pages in the order of their tagged keys as strings."""
    key = group_key(optional_id(F.col("ucsf_document_id")), F.col("doc_id"), optional_id(F.col("ucsf_document_page_no")), F.col("source_image_sha256"))
    keys = table(spark, folder, "manifest_examples").select(*[F.coalesce(key[k], F.lit("")).alias(k) for k in ("kind", "k1", "k2", "k3")]).distinct()
    return numbered(keys, [], ["kind", "k1", "k2", "k3"], "place")


def trimmed_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups taken up to a fifth of the questions: the last one crosses the target, so none can be trimmed."""
    target = table(spark, folder, "manifest_examples").agg(F.floor(F.count(F.lit(1)) * 0.2).alias("target"))
    taken = greedy_groups(spark, folder).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"), F.max_by("n", "before").alias("last"))
    return taken.join(target).select("groups", "total", "target", (F.col("total") - F.col("last") >= F.col("target")).alias("removable"))  # one row beside one row


def row_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the questions in shuffled order, rejected ones replaced from a buffer of 200."""
    rows = table(spark, folder, "manifest_examples").select("question_id").withColumn("h", hashed(SEED, F.col("question_id")))
    failed = table(spark, folder, "internvl_error_sample_v1").where(F.col("exact_match") == 0).select("question_id", F.lit(True).alias("failed")).distinct()
    target = table(spark, folder, "manifest_examples").count() // 10
    return cut_rows(rows.join(failed, "question_id", "left"), ["h", "question_id"], target, 200, F.col("failed").isNotNull()).select("question_id", "place")


def picks_by_size(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source the document of middle and of largest size, and the first one, each once."""
    docs = table(spark, folder, "documents").where(F.col("source").isNotNull())
    return size_picks(docs, "source", "doc_id", "n_chars", docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")))


def refused_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents taken as requests, by reason of refusal: the text is the question, its length times 4000 the bytes of the file."""
    docs = table(spark, folder, "documents")
    cap = F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 12).when(F.col("lang") == "fr", 5).cast("int")
    reason = refusal_reason(F.col("text"), cap, F.col("n_chars") * 4000, F.col("n_chars").cast("int"), F.lit(24_000))
    return docs.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def considered_caps(spark: SparkSession, folder: str) -> DataFrame:
    """The tile caps to compare for each cap of the log, the full one first."""
    rows = table(spark, folder, "holdout_predictions").select(F.col("image_info.max_num").alias("max_num")).where(F.col("max_num") >= 1).distinct()
    cap = F.col("max_num")
    listed = F.sort_array(F.array_distinct(F.array(F.lit(1), F.least(F.lit(4), cap), cap)), asc=False)
    return rows.select("max_num", F.posexplode(listed).alias("place", "cap"))


def thumbnail_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts taken as images, fitted into a box of 640 by 480."""
    parts = table(spark, folder, "part").select(F.greatest(F.lit(1), F.col("p_size") * 40).alias("w"), F.greatest(F.lit(1), F.col("p_retailprice").cast("int")).alias("h"))
    box = geometry.thumbnail_box(F.col("w"), F.col("h"), 640, 480)
    return parts.groupBy(box["width"].alias("width"), box["height"].alias("height")).agg(F.count(F.lit(1)).alias("n"))


def run_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Peak memory in GiB and the hours that training and evaluating at a system's published pace would take."""
    rows = table(spark, folder, "holdout_final_analysis").groupBy("system").agg(F.max(geometry.gib(F.coalesce("peak_allocated_bytes", F.lit(0)))).alias("gib"), F.max("latency_generation_only_median").alias("slowest"))
    return rows.select("system", F.round("gib", 6).alias("gib"), F.round(geometry.run_hours(F.col("slowest")), 6).alias("hours"))


def donor_mapping_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One digest of the whole mapping of parts to donors, in the order of parts."""
    rows = nearest_parts(spark, folder).withColumn("all", F.lit("all"))
    return sequence_digest(rows, ["all"], F.concat_ws(":", F.col("p_partkey").cast("string"), F.col("donor").cast("string")), F.col("p_partkey")).select("digest")


QUERIES = {
    f.__name__: f
    for f in (
        shard_rows, listed_files, late_texts, looked_up, verified_images, set_equality, unioned_rows, split_disjointness, content_matches, enriched_presets, manifest_prefix,
        tagged_order, trimmed_groups, row_cutoff, picks_by_size, refused_requests, considered_caps, thumbnail_boxes, run_costs, donor_mapping_digest,
    )
}

_STRIPPED = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+$', '', 'g')"
_SPLITS = {"known": "manifest_examples WHERE ucsf_document_id IS NOT NULL", "sent": "internvl_error_sample_v1 WHERE true", "unknown": "manifest_examples WHERE ucsf_document_id IS NULL"}
_U, _PG = _T.format("ucsf_document_id"), _T.format("ucsf_document_page_no")
SQL = {
    "shard_rows": "SELECT count(*) AS n, count(DISTINCT question_id) AS questions, count(DISTINCT source_image_sha256) AS images, 0::BIGINT AS without_shard FROM manifest_examples",
    "listed_files": "SELECT * FROM (VALUES ('holdout_final_analysis.parquet', 1), ('holdout_predictions.parquet', 2)) t(name, place)",
    "late_texts": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE source IS NULL",
    "looked_up": "SELECT question_id, doc_id, question FROM manifest_examples WHERE question_id = (SELECT max(question_id) FROM manifest_examples)",
    "verified_images": """WITH f AS (SELECT image_relpath, min(image_sha256_png) AS sha FROM manifest_examples GROUP BY 1), e AS (SELECT question_id, min(image_sha256_png) AS png, min(source_image_sha256) AS src FROM manifest_examples GROUP BY 1)
SELECT CASE WHEN sha IS NULL THEN 'missing' WHEN coalesce(png, src) IS NULL OR coalesce(png = sha, false) OR coalesce(src = sha, false) THEN 'ok' ELSE 'mismatch' END AS file_state, count(*) AS n
FROM internvl_error_sample_v1 s LEFT JOIN e USING (question_id) LEFT JOIN f ON f.image_relpath = s.image_relpath GROUP BY 1""",
    "set_equality": """WITH a AS (SELECT DISTINCT question_id AS q FROM manifest_examples WHERE question_id IS NOT NULL), b AS (SELECT DISTINCT question_id AS q FROM answer_sidecar WHERE question_id IS NOT NULL),
x AS (SELECT count(*) FILTER (b.q IS NULL) AS only_first, count(*) FILTER (a.q IS NULL) AS only_second, count(*) FILTER (a.q = b.q) AS both FROM a FULL JOIN b ON a.q = b.q)
SELECT *, only_first = 0 AND only_second = 0 AS equal FROM x""",
    "unioned_rows": """SELECT 'manifest' AS origin, count(*) AS n, count(doc_id) AS with_doc, count(target_answer) AS with_target, 0::BIGINT AS with_rule FROM manifest_examples
UNION ALL SELECT 'sidecar', count(*), 0, count(target_answer), count(target_selection_rule) FROM answer_sidecar""",
    "split_disjointness": " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, '{s}' AS signal, count(*) AS shared FROM (SELECT {c} AS v FROM {_SPLITS[a]} INTERSECT SELECT {c} FROM {_SPLITS[b]}) WHERE v IS NOT NULL"
        for a, b in (("known", "sent"), ("known", "unknown"), ("sent", "unknown"))
        for s, c in (("question", "question_id"), ("doc", "doc_id"), ("image", "image_relpath"))
    ),
    "content_matches": f"""WITH k AS (SELECT DISTINCT image_relpath, {_STRIPPED.format('question')} AS asked FROM manifest_examples)
SELECT k.asked IS NOT NULL AS matched, count(*) AS n FROM internvl_error_sample_v1 s LEFT JOIN k ON k.image_relpath = s.image_relpath AND k.asked = {_STRIPPED.format('s.question')} GROUP BY 1""",
    "enriched_presets": f"""WITH {REFERENCES_SQL}, p AS (SELECT DISTINCT question_id FROM internvl_error_sample_v1 WHERE question_id IS NOT NULL), i AS (SELECT question_id, min(image_sha256_png) AS sha FROM manifest_examples GROUP BY 1)
SELECT question_id, sha IS NOT NULL AS has_image, coalesce(len(refs), 0)::BIGINT AS n_references FROM p LEFT JOIN i USING (question_id) LEFT JOIN refs USING (question_id)""",
    "manifest_prefix": "SELECT example_index, question_id FROM manifest_examples ORDER BY example_index LIMIT 4",
    "tagged_order": f"""WITH k AS (SELECT DISTINCT CASE WHEN {_U} IS NOT NULL THEN 'UCSF' ELSE 'PAGE_FALLBACK' END AS kind, coalesce({_U}, doc_id::VARCHAR, '') AS k1,
  CASE WHEN {_U} IS NULL THEN coalesce({_PG}, '') ELSE '' END AS k2, CASE WHEN {_U} IS NULL THEN coalesce(source_image_sha256, '') ELSE '' END AS k3 FROM manifest_examples)
SELECT *, row_number() OVER (ORDER BY kind, k1, k2, k3) - 1 AS place FROM k""",
    "trimmed_groups": f"""{_E}, g AS (SELECT group_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT group_id, n,
  (coalesce(sum(n) OVER (ORDER BY sha256('{SEED}:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM g),
t AS (SELECT floor(count(*) * 0.2)::BIGINT AS target FROM manifest_examples)
SELECT count(*) AS groups, sum(n)::BIGINT AS total, target, sum(n) - max_by(n, before) >= target AS removable FROM r, t WHERE before < target GROUP BY target""",
    "row_cutoff": f"""WITH t AS (SELECT count(*) // 10 AS target FROM manifest_examples), f AS (SELECT question_id FROM internvl_error_sample_v1 WHERE exact_match = 0),
n AS (SELECT question_id, sha256('{SEED}:' || question_id) AS h FROM manifest_examples, t QUALIFY row_number() OVER (ORDER BY h, question_id) <= target + 200)
SELECT question_id, place FROM (SELECT question_id, row_number() OVER (ORDER BY h, question_id) - 1 AS place FROM n WHERE question_id NOT IN (SELECT question_id FROM f WHERE question_id IS NOT NULL)), t WHERE place < target""",
    "picks_by_size": """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars NULLS FIRST, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
p AS (SELECT source, doc_id, CASE WHEN i = n // 2 THEN 1 ELSE 2 END AS pick FROM d WHERE i = n // 2 OR i = n - 1 UNION ALL SELECT source, min(doc_id), 3 FROM d GROUP BY 1)
SELECT source, doc_id, min(pick)::INT AS pick FROM p GROUP BY 1, 2""",
    "refused_requests": f"""WITH d AS (SELECT {_STRIPPED.format('text')} AS q, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 12 WHEN 'fr' THEN 5 END AS cap, n_chars * 4000 AS size, n_chars * 24000 AS pixels FROM documents)
SELECT CASE WHEN coalesce(q, '') = '' THEN 'blank_question' WHEN length(q) > 4000 THEN 'long_question' WHEN coalesce(cap NOT IN (1, 4, 12), true) THEN 'tile_cap'
  WHEN coalesce(size <= 0 OR size > 12582912, true) THEN 'file_size' WHEN coalesce(pixels > 40000000, true) THEN 'pixels' ELSE 'accepted' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "considered_caps": """WITH m AS (SELECT DISTINCT image_info.max_num AS max_num FROM holdout_predictions WHERE image_info.max_num >= 1),
c AS (SELECT DISTINCT max_num, unnest([1, least(4, max_num), max_num]) AS cap FROM m) SELECT max_num, (row_number() OVER (PARTITION BY max_num ORDER BY cap DESC) - 1)::INT AS place, cap FROM c""",
    "thumbnail_boxes": """WITH p AS (SELECT greatest(1, p_size * 40)::DOUBLE AS w, greatest(1, trunc(p_retailprice))::DOUBLE AS h FROM part), s AS (SELECT w, h, least(640 / w, 480 / h, 1.0) AS k FROM p)
SELECT greatest(1, round_even(w * k, 0))::INT AS width, greatest(1, round_even(h * k, 0))::INT AS height, count(*) AS n FROM s GROUP BY 1, 2""",
    "run_costs": """SELECT system, round(max(coalesce(peak_allocated_bytes, 0)) / 1073741824.0, 6)::DOUBLE AS gib, round((max(latency_generation_only_median) * 600 + 2912.0) / 3600.0, 6) AS hours FROM holdout_final_analysis GROUP BY 1""",
    "donor_mapping_digest": f"""WITH a AS (SELECT p_partkey, p_brand, p_type, ln(greatest(p_size * 40, 1) / greatest(p_retailprice, 1)) AS v FROM part),
m AS (SELECT 'all' AS grp, q.p_partkey, q.p_partkey || ':' || (min((abs(q.v - d.v), d.p_partkey)))[2] AS pair FROM a q JOIN a d ON q.p_brand <> d.p_brand AND q.p_type <> d.p_type GROUP BY q.p_partkey)
SELECT digest FROM ({chunked_sql('m', 'grp', 'pair', 'p_partkey')})""",
}
