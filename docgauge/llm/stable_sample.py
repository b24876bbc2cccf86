"""A sample that stays the same as the data grow.

A record's persistent number times the golden ratio, plus a fixed shift, has a
fractional part; the record is in the sample if that part lies in a fixed
interval.  Membership is a function of the number alone, so it is the same for
any order or partitioning, and nothing that is added later can change it.
Multiples of the golden ratio fill the interval more evenly than chance, so
any run of numbers gives nearly the share asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 10**18 over the golden ratio, made odd and no multiple of five, so that a
#: whole period of numbers takes each of the 10**18 positions once.
GOLDEN = 618_033_988_749_894_849
TURN = 10**18
#: Position of number 0, in TURN-ths of a turn.
SHIFT = 271_828_182_845_904_523


def position(number: Column, *, shift: int = SHIFT) -> Column:
    """Exact position of a number on the circle, 0 <= position < TURN."""
    turned = number.cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(18,0)")
    on_circle = F.pmod(F.pmod(turned, F.lit(TURN).cast("decimal(19,0)")) + F.lit(shift).cast("decimal(18,0)"), F.lit(TURN).cast("decimal(19,0)"))
    return on_circle.cast("long")


def stable_sample(records: DataFrame, number: str, share: float, *, shift: int = SHIFT) -> DataFrame:
    """The distinct ``number``s in the sample, with their ``position``.

    ``number`` must be an integer that identifies a record for good.  Nulls
    identify nothing and are left out; repeated rows count once; negative
    numbers are allowed.  Rows outside the sample are dropped before the
    shuffle, and copies are combined on the map side.  A share of 0 or less
    gives nothing, of 1 or more everything.
    """
    wide = round(min(1.0, max(0.0, share)) * TURN)
    placed = records.where(F.col(number).isNotNull()).select(F.col(number), position(F.col(number), shift=shift).alias("position"))
    return placed.where(F.col("position") < F.lit(wide)).groupBy(number).agg(F.first("position").alias("position"))
