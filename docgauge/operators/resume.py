"""Resuming an append log without doing or counting anything twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.operators.coverage import enforce


def pending(required: DataFrame, log: DataFrame, key: str, fingerprint: str, expected: str) -> DataFrame:
    """Required keys without an ok row of the expected fingerprint."""
    done = log.where((F.col("status") == "ok") & (F.col(fingerprint) == expected)).select(key)
    return required.select(key).join(done, key, "left_anti")


def incoherent_runs(log: DataFrame, run: list[str], fingerprint: str) -> DataFrame:
    """Runs whose rows carry several fingerprints, or none."""
    prints = F.count_distinct(fingerprint)
    return log.groupBy(*run).agg(prints.alias("fingerprints"), F.count_if(F.col(fingerprint).isNull()).alias("unmarked")).where((F.col("fingerprints") != 1) | (F.col("unmarked") > 0))


def guard_append(log: DataFrame, fingerprint: str, expected: str) -> None:
    """Raises if a log has rows, and not all of them are of the expected fingerprint."""
    enforce(log.where(~F.coalesce(F.col(fingerprint) == expected, F.lit(False))), "rows of another fingerprint")


def guard_hardware(log: DataFrame, gpu: str, current: str, *, allow_mixed: bool = False) -> None:
    if not allow_mixed:
        enforce(log.where(F.col(gpu).isNotNull() & (F.col(gpu) != current)).select(gpu).distinct(), "rows made on other hardware")


def run_states(log: DataFrame, expected: DataFrame, run: list[str], record: str, fingerprint: str, *, least: float = 1.0) -> DataFrame:
    """Each expected run as missing, incompatible or ok_complete, with its problems.

    ``expected`` has the columns of ``run`` and ``expected``, the number of its
    records.  A log can be used again if one fingerprint made all of it and it
    has, but for a part of ``1 - least``, as many records and no more.
    """
    seen = log.groupBy(*run).agg(F.count_distinct(record).alias("found"), F.count_distinct(fingerprint).alias("prints"), F.count_if(F.col(fingerprint).isNull()).alias("unmarked"))
    both = expected.join(seen, run, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    there = F.col("found") > 0
    problems = F.array_compact(
        F.array(
            F.when(there & ((F.col("prints") != 1) | (F.col("unmarked") > 0)), "fingerprints"),
            F.when(there & (F.col("found") < F.col("expected") * F.lit(least)), "too few"),
            F.when(F.col("found") > F.col("expected"), "too many"),
        )
    )
    state = F.when(~there, "missing").when(F.size(problems) > 0, "incompatible").otherwise("ok_complete")
    return both.select(*run, state.alias("state"), F.array_join(problems, ",").alias("problems"), "expected", "found")


def weight_sets(log: DataFrame, wanted: DataFrame, run: list[str], weight: str) -> DataFrame:
    """How many kinds of ``weight`` each run has, and whether all its rows have the ``wanted`` one."""
    same = F.coalesce(F.col(weight) == F.col("wanted"), F.lit(False))
    return log.join(wanted, run).groupBy(*run).agg(F.count_distinct(weight).alias("kinds"), F.bool_and(same).alias("as_wanted"))
