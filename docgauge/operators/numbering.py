"""Dense numbers of ordered rows, without a task that sees a whole series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.session import cut

_RANGE = "__range"


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "__place") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 ... within ``by`` in the order of ``order``.

    Rows are range-partitioned by both and written down, so a long series is
    spread over many ranges; each range numbers its rows, and offsets are
    summed over the counts of the ranges.  Nulls of ``order`` come first; rows
    equal in it are numbered in any order.
    """
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn(_RANGE, F.spark_partition_id()))
    counts = ranged.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("__n"))
    # one row a series and range
    ends = F.sum("__n").over(Window.partitionBy(*by).orderBy(_RANGE))
    offsets = counts.select(*by, _RANGE, (ends - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, _RANGE).orderBy(*order)) - 1
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, _RANGE]]
    placed = ranged.withColumn("__inside", inside).alias("r").join(offsets.alias("o"), same)
    return placed.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("o.__start") + F.col("r.__inside")).alias(name))
