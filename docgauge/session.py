"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: dict[int, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any scheme, so that a shared store is seen as well as a local one."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return java.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), java


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, which may be a glob, names anything."""
    files, java = _files(spark, path)
    found = files.globStatus(java)
    return found is not None and len(found) > 0


def is_folder(spark: SparkSession, path: str) -> bool:
    files, java = _files(spark, path)
    return files.getFileStatus(java).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, replaced if it is there."""
    files, java = _files(spark, path)
    out = files.create(java, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that setting is absent a folder of this machine is used if driver and
    executors are one process; on a cluster that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docgauge-")
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, of a folder that is deleted when the driver's JVM ends."""
    own = f"{shared_checkpoint_dir(spark)}/docgauge-{spark.sparkContext.applicationId}"
    files, java = _files(spark, own)
    files.mkdirs(java)
    files.deleteOnExit(java)
    return f"{own}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This cuts the lineage: losing executors afterwards costs nothing.  Unlike
    ``checkpoint()`` it computes ``df`` once.  The table lives until
    :func:`discard`, or else until the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(kept)] = path
    weakref.finalize(kept, _WRITTEN.pop, id(kept), None)
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes the table behind a result of :func:`cut` that is needed no more."""
    path = _WRITTEN.pop(id(kept), None)
    if path:
        files, java = _files(kept.sparkSession, path)
        files.delete(java, True)
