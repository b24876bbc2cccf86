"""JSON lines with the order they were written in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.operators.coverage import enforce, last_by_key, repeated_keys, unexpected_keys
from docgauge.session import exists

#: Orders records as they stand in their files: by path, by the start of the
#: split, and by the place in the split.
PLACE = "__place"


def read_jsonl(spark: SparkSession, path: str, schema: str, *, tolerant: bool = False) -> DataFrame:
    """Records with ``__place``; blank lines are skipped, a missing path is empty.

    Bad lines raise, or are skipped if ``tolerant``.  Files stay splittable:
    the rows of one split carry increasing ids in the order they are read.
    """
    kind = T._parse_datatype_string(schema)
    if not exists(spark, path):
        place = T.StructType().add("path", "string").add("start", "long").add("id", "long")
        return spark.createDataFrame([], T.StructType([*kind.fields, T.StructField(PLACE, place)]))
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).alias(PLACE)
    )
    lines = lines.where(F.trim("value") != "")
    wide = T.StructType([*kind.fields, T.StructField("__bad", T.StringType())])
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), PLACE)
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    if tolerant:
        parsed = parsed.where(~bad)
    else:
        parsed = parsed.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("bad JSON line: "), F.coalesce("r.__bad", F.lit("null"))))).otherwise(F.col("r")))
    return parsed.select(*[F.col(f"r.{f.name}") for f in kind.fields], PLACE)


def read_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record of each key."""
    return last_by_key(read_jsonl(spark, path, schema), [key], [PLACE]).drop(PLACE)


def read_once(spark: SparkSession, path: str, schema: str, key: str, required: DataFrame) -> DataFrame:
    """Records whose keys must be unique and required; raises otherwise."""
    records = read_jsonl(spark, path, schema).drop(PLACE)
    enforce(repeated_keys(records, [key]), "duplicate records")
    enforce(unexpected_keys(records, required, key), "unexpected records")
    return records


def read_compatible(spark: SparkSession, path: str, schema: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(records of the run with this fingerprint, records of others); bad lines are skipped."""
    records = read_jsonl(spark, path, schema, tolerant=True)
    same = F.coalesce(F.col("run_fingerprint.run_fingerprint_sha256") == fingerprint, F.lit(False))
    return records.where(same), records.where(~same)


def first_match(records: DataFrame, condition) -> DataFrame:
    """The first record, as written, that meets a condition."""
    return records.where(condition).orderBy(PLACE).limit(1)
