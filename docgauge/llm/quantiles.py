"""Percentiles per group from mergeable sketches with a stated rank error.

A sketch is a hierarchy of compactors: values enter level 0; a level that is
over its capacity is sorted and every second value moves up with twice the
weight, the offset being a coin.  Sketches merge level by level, so figures of
longer spans follow from kept sketches of shorter ones.

Each compaction at level ``h`` shifts the rank of any value by at most
``2**h`` with mean zero.  A sketch keeps the sum of the squares of these
shifts, so by Hoeffding's inequality every rank is within
``sqrt(2 * square_shift * ln(2 / delta)) / n`` of the true one with
probability ``1 - delta``.  That needs coins that do not depend on each other
or on the values: a coin is a digest of the sketch's name (its group and the
part of the input it is of) and the number of the compaction.  Groups below
the capacity are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.session import cut, discard

#: Capacity of the highest compactor; lower ones shrink by SHRINK, to LEAST.
CAPACITY = 1024
SHRINK = 2 / 3
LEAST = 8
#: Chance that a stated rank error does not hold.
DELTA = 1e-6
#: Partial sketches that a task holds before it hands them on.
HELD = 20_000
#: Rows of one salted piece of a group, roughly.
PIECE_ROWS = 50_000_000
#: Sketches of a group that one task merges, roughly; more are merged in a tree.
FAN_IN = 64

_SKETCH = "n long, square_shift double, levels array<array<double>>"


def _capacity(level: int, levels: int, capacity: int) -> int:
    return max(LEAST, math.ceil(capacity * SHRINK ** (levels - 1 - level)))


class Compactors:
    """The state of one sketch; ``name`` tells its coins from those of all others."""

    def __init__(self, capacity: int, name: object) -> None:
        self.capacity, self.n, self.square_shift = capacity, 0, 0.0
        self.name, self.compactions, self.coins = repr(name).encode(), 0, 0
        self.levels: list[list[np.ndarray]] = [[]]
        self.sizes = [0]

    def add(self, level: int, values: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.sizes.append(0)
        self.levels[level].append(values)
        self.sizes[level] += len(values)

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.add(0, values)
        if self.sizes[0] > 2 * self.capacity:
            self.compact()

    def merge(self, n: int, square_shift: float, levels: Sequence[np.ndarray]) -> None:
        self.n += n
        self.square_shift += square_shift
        for level, values in enumerate(levels):
            self.add(level, np.asarray(values, dtype="f8"))
        self.compact()

    def coin(self) -> int:
        """The next of a row of fair coins, 256 to a digest: the same for the same sketch at every run."""
        at = self.compactions & 255
        if at == 0:
            self.coins = int.from_bytes(hashlib.sha256(self.name + b"%d" % self.compactions).digest())
        self.compactions += 1
        return self.coins >> at & 1

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if self.sizes[level] > _capacity(level, len(self.levels), self.capacity) and self.sizes[level] > 1:
                values = np.sort(np.concatenate(self.levels[level]))
                even = len(values) & ~1
                self.levels[level], self.sizes[level] = [values[even:]], len(values) - even
                self.square_shift += 4.0**level
                self.add(level + 1, values[self.coin() : even : 2])
                level = 0 if level + 2 == len(self.levels) else level
            level += 1

    def row(self) -> tuple[int, float, list[np.ndarray]]:
        self.compact()
        return self.n, self.square_shift, [np.sort(np.concatenate(x)) if x else np.empty(0) for x in self.levels]


def _frame(done: list[tuple], keys: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(done, columns=[*keys, "n", "square_shift", "levels"])


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def build_sketches(values: DataFrame, keys: Sequence[str], value: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Partial sketches of ``value`` per ``keys``, one or more for a group.

    Null and NaN values are left out; infinite ones are ordinary extremes.
    Keys may be null: that is a group.  An empty table has no sketches.
    :func:`merge_sketches` makes one row per group of the result.
    """
    keys = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, passed = TaskContext.get().partitionId(), 0
        held: dict[tuple, Compactors] = {}
        for batch in batches:
            numbers = batch[value].to_numpy(dtype="f8")
            codes = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(order) else []
            names = list(batch[keys].iloc[order[starts]].itertuples(index=False, name=None)) if len(order) else []
            for name, rows in zip(names, np.split(numbers[order], starts[1:]) if len(order) else []):
                name = tuple(None if x is None or x is pd.NaT or x != x else x for x in name)
                if name not in held:
                    held[name] = Compactors(capacity, (name, part, passed))
                held[name].update(rows)
            if len(held) > HELD:
                yield _frame([(*name, *s.row()) for name, s in held.items()], keys)
                held, passed = {}, passed + 1
        yield _frame([(*name, *s.row()) for name, s in held.items()], keys)

    clean = values.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.mapInPandas(partial, f"{_kinds(values, keys)}, {_SKETCH}")


def _merged(sketches: DataFrame, keys: list[str], capacity: int, step: int) -> DataFrame:
    """One sketch per ``keys``, merged in one task each, in the order of a sort."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, done = None, None, []
        for batch in batches:
            columns = [batch[k] for k in keys]
            for *key, n, shift, levels in zip(*columns, batch["n"], batch["square_shift"], batch["levels"]):
                key = tuple(None if x is None or x is pd.NaT or x != x else x for x in key)
                if state is None or key != name:
                    if state is not None:
                        done.append((*name, *state.row()))
                    name, state = key, Compactors(capacity, (key, keys, step))
                state.merge(n, shift, levels)
            if len(done) > 1000:
                yield _frame(done, keys)
                done = []
        if state is not None:
            done.append((*name, *state.row()))
        yield _frame(done, keys)

    parts = sketches.select(*keys, "n", "square_shift", "levels").repartition(*keys).sortWithinPartitions(*keys, "n", "square_shift", F.hash("levels"))
    return parts.mapInPandas(merge, f"{_kinds(sketches, keys)}, {_SKETCH}")


def merge_sketches(sketches: DataFrame, keys: Sequence[str], *, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """One sketch per ``keys`` from sketches of parts of it.

    ``sketches`` should be a written table (:func:`docgauge.session.cut`).  No
    task merges more than about twice ``fan_in`` sketches of a group: where a
    group has more, salted pieces of it are merged first, and so on upwards.
    """
    keys, step = list(keys), 0
    while True:
        most = sketches.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts")).agg(F.max("parts")).first()[0] or 0
        if most <= 2 * fan_in:
            return _merged(sketches, keys, capacity, step)
        salts = -(-most // fan_in)
        salted = sketches.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        upper = cut(_merged(salted, [*keys, "__salt"], capacity, step))
        if step:
            discard(sketches)
        sketches, step = upper, step + 1


def rank_error(delta: float = DELTA) -> Column:
    """The bound on the error of any rank in a sketch, as a share of ``n``."""
    return F.sqrt(F.col("square_shift") * F.lit(2 * math.log(2 / delta))) / F.col("n")


def share(figure: Column, *, inclusive: bool) -> Column:
    """Share of a sketch's values below ``figure``, or not above it."""

    def weight(values: Column, level: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= figure if inclusive else v < figure)) * F.pow(F.lit(2.0), level)

    return F.aggregate(F.transform("levels", weight), F.lit(0.0), lambda total, w: total + w) / F.col("n")


def quantile(p: float) -> Column:
    """The value at rank ``p``: the least whose share is ``p`` or more."""
    pairs = F.array_sort(F.flatten(F.transform("levels", lambda values, level: F.transform(values, lambda v: F.struct(v.alias("value"), F.pow(F.lit(2.0), level).alias("weight"))))))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("value"))

    def step(state: Column, pair: Column) -> Column:
        reached = state["value"].isNotNull()
        seen = state["seen"] + pair["weight"]
        return F.struct(seen.alias("seen"), F.when(reached, state["value"]).when(seen >= F.col("n") * F.lit(p), pair["value"]).alias("value"))

    return F.aggregate(pairs, start, step, lambda state: state["value"])


def latency_values(log: DataFrame) -> DataFrame:
    """(run_tag, system, eval_day, generation_seconds) of the log, once per record.

    Kept are rows with status ok that are no warm-up and took a positive
    finite time.  Copies of a record meet by run, system, day and a salt of
    the record; the salts grow with the log, so a day that holds a third of
    it is still split, while small logs are not cut into crumbs.
    """
    salts = max(1, min(4096, log.count() // PIECE_ROWS))
    good = (F.col("status") == "ok") & ~F.coalesce("is_warmup", F.lit(True)) & (F.col("generation_seconds") > 0) & ~F.isnan("generation_seconds") & (F.col("generation_seconds") < F.lit(float("inf")))
    kept = log.where(good).select("run_tag", "system", "eval_day", F.pmod(F.xxhash64("record_id"), F.lit(salts)).alias("salt"), "record_id", "generation_seconds")
    once = kept.repartition("run_tag", "system", "eval_day", "salt").groupBy("run_tag", "system", "eval_day", "salt", "record_id").agg(F.min("generation_seconds").alias("generation_seconds"))
    return once.select("run_tag", "system", "eval_day", "generation_seconds")
