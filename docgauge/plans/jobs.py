"""What steers a job: its settings, which runs are still to be made, what it reports of training."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge import schema
from docgauge.operators import stats
from docgauge.operators.coverage import enforce
from docgauge.session import exists, write_text
from docgauge.sources.jsonl import PLACE, read_jsonl


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings of a file: JSON, or YAML where a parser for it is installed; anything but an object raises."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            found = importlib.import_module("yaml").safe_load(text)
        except ModuleNotFoundError as missing:
            raise ValueError(f"{path}: no YAML parser is installed") from missing
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


def derived_settings(base: Mapping, changes: Mapping, *, root: str, outputs: Sequence[str], forbidden: Sequence[str]) -> dict:
    """``base`` with ``changes``, checked: the ``outputs`` lie under ``root``, and no value anywhere names a ``forbidden`` path."""
    settings = {**base, **changes}
    for name in outputs:
        path = PurePosixPath(str(settings.get(name, "")))
        if ".." in path.parts or not path.is_relative_to(root):
            raise ValueError(f"{name} is {path}, outside {root}")
    whole = json.dumps(settings, default=str)
    named = [path for path in forbidden if path in whole]
    if named:
        raise ValueError(f"the settings name {named}")
    return settings


def predictor_of(settings: Mapping, makers: Mapping[str, Callable[[Mapping], Callable[[str], str]]], *, field: str = "adapter", default: str = "default") -> Callable[[], Callable[[str], str]]:
    """A maker of the predictor that the settings ask for, to be called once a task; an unknown kind raises at once."""
    kind = str(settings.get(field) or default)
    if kind not in makers:
        raise ValueError(f"unknown {field} {kind!r}; known are {sorted(makers)}")
    make = makers[kind]
    return lambda: make(settings)


def run_missing(spark: SparkSession, states: Mapping[str, tuple[str, Sequence[str]]], make: Callable[[str], None], analyse: Callable[[], None], done: str) -> list[str]:
    """Makes the runs that are missing, analyses all, and leaves a marker; returns what was made.

    ``states`` are those of :func:`docgauge.plans.flows.cache_state`.  An
    incompatible run stops the job before anything is made; where the marker
    is there and nothing is missing, nothing is done again.
    """
    wrong = {name: list(why) for name, (state, why) in states.items() if state == "incompatible"}
    if wrong:
        raise ValueError(f"incompatible runs: {wrong}")
    missing = [name for name, (state, _) in states.items() if state == "missing"]
    if not missing and exists(spark, done):
        return []
    for name in missing:
        make(name)
    analyse()
    write_text(spark, done, json.dumps({"made": missing}) + "\n")
    return missing


def training_report(spark: SparkSession, path: str, *, size: int = 20) -> DataFrame:
    """One row of a training log: whether its updates are 1 to n, first and last means of the loss, peak memory, examples seen."""
    log = read_jsonl(spark, path, schema.TRAINING_LOG).withColumn("run", F.lit("run"))
    enforce(log.where(F.col("update").isNull()).select(PLACE), "lines without an update")
    ends = stats.end_means(log, ["run"], ["update"], "loss", size)
    whole = log.groupBy("run").agg(
        F.count(F.lit(1)).alias("updates"), stats.is_contiguous(F.col("update")).alias("contiguous"), F.max("samples_seen").alias("samples_seen"),
        F.max("unique_examples_seen").alias("unique_examples_seen"), F.max("peak_allocated_bytes").alias("peak_allocated_bytes"), F.max_by("loss", "update").alias("last_loss"),
    )
    return whole.join(ends, "run").drop("run")
