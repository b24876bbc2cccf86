"""Manifests, answer sidecars, parquet shards and binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge import schema
from docgauge.functions.text import first_valid, strip
from docgauge.operators.coverage import enforce


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, examples in their order) of manifest files."""
    whole = spark.read.option("multiLine", True).schema(schema.MANIFEST).json(path)
    examples = whole.select(F.posexplode("examples").alias("position", "e")).select("position", "e.*")
    return whole.drop("examples"), examples


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sidecar: an object with ``answers`` or ``records``, or a bare list; anything else raises."""
    row = schema._ANSWER
    raw = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("v"))
    listed = F.from_json("v", f"array<{row}>")
    held = F.from_json("v", f"answers array<{row}>, records array<{row}>")
    rows = F.when(F.col("v").startswith("["), listed).when(F.col("v").startswith("{"), F.coalesce(held["answers"], held["records"]))
    return raw.select(F.explode(F.coalesce(rows, F.raise_error(F.lit("neither answers, records nor a list")))).alias("r")).select("r.*")


def target(own: Column, answers: Column) -> Column:
    """A training target: the own one, else the first valid answer."""
    return F.coalesce(F.nullif(strip(own), F.lit("")), first_valid(answers))


def scan_shards(spark: SparkSession, path: str, columns: Sequence[str], *, pattern: str | None = None) -> DataFrame:
    """The named columns of parquet shards and the file each row is from; raises if no file matches."""
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    return reader.parquet(path).select(*columns, F.col("_metadata.file_name").alias("source_shard"))


def list_files(spark: SparkSession, folder: str, *, prefix: str = "", suffix: str = "") -> DataFrame:
    """(name, place): files and tables of a folder on any file system, by name; raises if there is none."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = java.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(java)
    names = sorted(n for n in (f.getPath().getName() for f in found) if n.startswith(prefix) and n.endswith(suffix))
    if not names:
        raise FileNotFoundError(f"no {prefix}*{suffix} in {folder}")
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, place int")


def missing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` of all paths ``listed``; raises, naming some, if one is not there."""
    enforce(listed.select("path").join(files.select("path"), "path", "left_anti"), "files are missing")
    return files.join(listed.select("path").distinct(), "path", "left_semi")


def late_columns(spark: SparkSession, path: str, key: str, wanted: DataFrame, heavy: Sequence[str]) -> DataFrame:
    """Heavy columns for wanted keys alone, from a second pruned scan."""
    return spark.read.parquet(path).select(key, *heavy).join(wanted.select(key), key, "left_semi")


def point_lookup(spark: SparkSession, path: str, key: str, value: int, columns: Sequence[str]) -> DataFrame:
    """The row of one key; the filter reaches the parquet scan."""
    found = spark.read.parquet(path).where(F.col(key) == value).select(key, *columns)
    if found.isEmpty():
        raise KeyError(f"{key} {value} is not in {path}")
    return found


def file_digests(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """(path, length, sha256) of whole files."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_files(examples: DataFrame, files: DataFrame, path: str, *expected: str) -> DataFrame:
    """``examples`` with ``file_state``: missing, ok, mismatch, or ok where nothing is expected."""
    hashes = files.select(F.col("path").alias(path), F.col("sha256").alias("__sha"))
    known = F.coalesce(*[F.col(c) for c in expected])
    matches = F.lit(False)
    for c in expected:
        matches = matches | F.coalesce(F.col(c) == F.col("__sha"), F.lit(False))
    state = F.when(F.col("__sha").isNull(), "missing").when(known.isNull() | matches, "ok").otherwise("mismatch")
    return examples.join(hashes, path, "left").withColumn("file_state", state).drop("__sha")
