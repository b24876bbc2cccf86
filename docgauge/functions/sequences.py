"""Token sequences: where supervision ends, and how masks are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = -100


def terminated(ids: Column, prompt: Column, end: Column) -> Column:
    """Ids up to the first end token after the prompt, or with one appended; null if nothing follows the prompt."""
    suffix = F.slice(ids, prompt + 1, F.size(ids))
    at = F.array_position(suffix, end)
    cut = F.slice(ids, F.lit(1), (prompt + at).cast("int"))
    return F.when(F.size(ids) > prompt, F.when(at > 0, cut).otherwise(F.array_append(ids, end)))


def termination_fault(ids: Column, prompt: Column, end: Column) -> Column:
    """Null if the part after the prompt has exactly one end token, as its last; else what is wrong."""
    suffix = F.slice(ids, prompt + 1, F.size(ids))
    count = F.size(F.filter(suffix, lambda x: x == end))
    return (
        F.when(F.size(suffix) == 0, "empty")
        .when(count == 0, "no end")
        .when(count > 1, "several ends")
        .when(F.element_at(suffix, -1) != end, "end not last")
    )


def mask_runs(labels: Column) -> Column:
    """Labels as text, a run of masked ones written [MASK×n]."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("run"))
    flush = lambda s: F.when(s["run"] > 0, F.concat(s["text"], F.lit(" [MASK×"), s["run"].cast("string"), F.lit("]"))).otherwise(s["text"])

    def step(state: Column, label: Column) -> Column:
        masked = F.struct(state["text"].alias("text"), (state["run"] + 1).alias("run"))
        shown = F.struct(F.concat(flush(state), F.lit(" "), label.cast("string")).alias("text"), F.lit(0).alias("run"))
        return F.when(label == MASKED, masked).otherwise(shown)

    return F.ltrim(F.aggregate(labels, start, step, flush))
