"""The append log as a stream: scored once, and summed up over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docgauge.operators.deliveries import one_per_message
from docgauge.session import is_folder
from docgauge.sinks.reports import append_records


def opened(spark: SparkSession, source: str, schema: StructType | str, fmt: str) -> DataFrame:
    """A stream of the files of a folder; of a single file, of all in its folder that bear its name."""
    reader = spark.readStream.schema(schema).format(fmt)
    if not is_folder(spark, source):
        folder, _, name = source.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(source)


def stream_once(spark: SparkSession, source: str, schema: StructType | str, store: str, checkpoint: str, keys: list[str], score: Callable[[DataFrame], DataFrame], *, fmt: str = "parquet") -> StreamingQuery:
    """Scores whatever is new in ``source`` and appends it to ``store``, then ends.

    A batch that is replayed after a failure adds nothing: rows are kept once
    per ``keys``.
    """
    rows = opened(spark, source, schema, fmt)
    return rows.writeStream.foreachBatch(lambda batch, _: append_records(score(batch), store, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_unique(spark: SparkSession, source: str, schema: StructType | str, checkpoint: str, sink: Callable[[DataFrame, int], None], key: str, order_by: list[str], *, fmt: str = "parquet") -> StreamingQuery:
    """Hands each batch on with one row per message; a sink that merges by key makes it once overall."""
    rows = opened(spark, source, schema, fmt)
    return rows.writeStream.foreachBatch(lambda batch, n: sink(one_per_message(batch, key, order_by), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(rows: DataFrame, *, time: str, late: str = "3 days", size: str = "1 day") -> DataFrame:
    """Counts and mean seconds per system and window; rows later than ``late`` are dropped."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), "system").agg(F.count(F.lit(1)).alias("n"), F.avg("generation_seconds").alias("mean_seconds")).select(F.col("window.start").alias("start"), "system", "n", "mean_seconds")
