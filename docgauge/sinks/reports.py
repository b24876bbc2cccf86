"""Reports, append stores and what guards them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docgauge.session import cut, discard, exists, write_text

#: Rows that a report may hold; larger results are tables, not reports.
REPORT_ROWS = 10_000
#: Files above this size stay out of a review packet.
PACKET_BYTES = 8 * 1024 * 1024
# Endings of files that a packet does not show.
BINARY = ("png", "jpg", "jpeg", "pdf", "parquet", "safetensors", "zip", "gz", "bin")


def confined(path: str | Path, root: str | Path) -> Path:
    """``path`` if it lies under ``root``; raises otherwise."""
    full = Path(path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{full} is outside {root}")
    return full


def refuse_overwrite(spark: SparkSession, paths: Sequence[str | Path], *, overwrite: bool = False) -> None:
    """Raises, naming all outputs that exist on whatever file system, before any work is done."""
    there = [str(p) for p in paths if exists(spark, str(p))]
    if there and not overwrite:
        raise FileExistsError(f"outputs exist: {there}")


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: write a table")
    return [r.asDict(recursive=True) for r in rows]


def write_report(df: DataFrame, path: str | Path) -> None:
    """Rows of a small result as indented JSON."""
    write_text(df.sparkSession, str(path), json.dumps(_rows(df), indent=2, default=str, ensure_ascii=False) + "\n")


def write_markdown(df: DataFrame, path: str | Path, title: str) -> None:
    cell = lambda v: ("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", r"\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in _rows(df)]
    write_text(df.sparkSession, str(path), "\n".join(lines) + "\n")


def _scaled(values: Sequence[float], low: float, high: float) -> list[float]:
    """Values between two places; equal ones lie in the middle."""
    least, most = min(values), max(values)
    return [(low + high) / 2 if most == least else low + (v - least) * (high - low) / (most - least) for v in values]


def _drawn(width: int, height: int, *marks: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(marks)}</svg>\n'


def write_bar_chart(df: DataFrame, label: str, values: Sequence[str], path: str | Path, *, width: int = 640, height: int = 320, margin: int = 40) -> None:
    """Grouped bars from 0, one group a row; nulls and negative values have no bar."""
    rows = _rows(df.select(label, *values))
    most = max([v for r in rows for k in values if (v := r[k]) is not None and v > 0], default=0)
    step = (width - 2 * margin) / max(1, len(rows))
    thick = 0.8 * step / max(1, len(values))
    marks = []
    for i, r in enumerate(rows):
        for j, k in enumerate(values):
            if most and r[k] is not None and r[k] > 0:
                tall = float(r[k]) / float(most) * (height - 2 * margin)
                marks.append(f'<rect x="{margin + i * step + j * thick:.1f}" y="{height - margin - tall:.1f}" width="{thick:.1f}" height="{tall:.1f}" fill="hsl({360 * j // max(1, len(values))},50%,50%)"/>')
        marks.append(f'<text x="{margin + i * step:.1f}" y="{height - margin / 2}">{escape(str(r[label]))}</text>')
    write_text(df.sparkSession, str(path), _drawn(width, height, *marks))


def write_scatter(df: DataFrame, x: str, y: str, path: str | Path, *, width: int = 640, height: int = 320, margin: int = 40, ticks: int = 5) -> None:
    """Points with as many ticks as there are values, at most ``ticks``."""
    points = [(float(r[x]), float(r[y])) for r in _rows(df.select(x, y)) if r[x] is not None and r[y] is not None]
    marks = []
    if points:
        xs, ys = _scaled([p[0] for p in points], margin, width - margin), _scaled([p[1] for p in points], height - margin, margin)
        marks = [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3"/>' for a, b in zip(xs, ys)]
        shown = sorted({p[0]: a for p, a in zip(points, xs)}.items())
        marks += [f'<text x="{a:.1f}" y="{height - margin / 2}">{v:g}</text>' for v, a in shown[:: max(1, -(-len(shown) // ticks))]]
    write_text(df.sparkSession, str(path), _drawn(width, height, *marks))


def figures(made: Mapping[str, Callable[[], None]]) -> dict[str, str | None]:
    """Draws each figure; what went wrong with one is noted and stops neither the others nor the job."""
    errors: dict[str, str | None] = {}
    for name, draw in made.items():
        try:
            draw()
            errors[name] = None
        except Exception as fault:  # noqa: BLE001
            errors[name] = f"{type(fault).__name__}: {fault}"
    return errors


def packet_totals(inventory: DataFrame) -> DataFrame:
    """One row of a review inventory: files by status, and bytes that are included."""
    names = ("included", "missing", "skipped_binary", "skipped_too_large")
    return inventory.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names], F.coalesce(F.sum(F.when(F.col("status") == "included", F.col("length"))), F.lit(0)).alias("bytes"))


def write_line_chart(df: DataFrame, x: str, y: str, path: str | Path, *, width: int = 640, height: int = 320, margin: int = 40) -> None:
    """A series as SVG; a constant series runs through the middle, an empty one has no line."""
    points = sorted((r[x], r[y]) for r in _rows(df.select(x, y)) if r[x] is not None and r[y] is not None)

    line = ""
    if points:
        xs = _scaled([float(p[0]) for p in points], margin, width - margin)
        ys = _scaled([float(p[1]) for p in points], height - margin, margin)
        line = f'<polyline fill="none" stroke="black" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in zip(xs, ys))}"/>'
    write_text(df.sparkSession, str(path), _drawn(width, height, line, f'<text x="{margin}" y="20">{escape(y)}</text>'))


#: Folders of a store.  A batch is held against the keys of those it writes to.
STORE_FOLDERS = 64
_FOLDER = "__folder"


def stored(spark: SparkSession, store: str, schema: StructType | str) -> DataFrame:
    """The rows of an append store; an empty table where there is none yet."""
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    if not exists(spark, store):
        return spark.createDataFrame([], kind)
    return spark.read.schema(StructType([*kind.fields, StructField(_FOLDER, IntegerType())])).parquet(store).drop(_FOLDER)


def append_records(records: DataFrame, store: str, keys: Sequence[str], *, order: Sequence[str] | None = None) -> None:
    """Appends what the store does not have yet, one row per key: repeating a batch changes nothing.

    Of several rows of a key the first in ``order`` stays, by default that of
    the smallest values, so a replayed batch keeps the same one.  A small batch
    reads the keys of the folders it falls into, not the whole store.
    """
    spark, keys = records.sparkSession, list(keys)
    rest = [c for c in records.columns if c not in keys]
    place = F.struct(*order) if order else F.struct(*[F.to_json(F.struct(c)) for c in rest] or [F.lit(1)])
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("__row")).select(*keys, "__row.*") if rest else records.select(*keys).distinct()
    new = first.select(*records.columns).withColumn(_FOLDER, F.pmod(F.xxhash64(*keys), F.lit(STORE_FOLDERS)).cast("int"))
    if exists(spark, store):
        new = cut(new)
        # at most STORE_FOLDERS numbers
        folders = [r[0] for r in new.select(_FOLDER).distinct().collect()]
        kind = StructType([*records.schema.fields, StructField(_FOLDER, IntegerType())])
        old = spark.read.schema(kind).parquet(store).where(F.col(_FOLDER).isin(folders)).select(*keys, _FOLDER)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col(f"n.{_FOLDER}") == F.col(f"o.{_FOLDER}")]
        new.alias("n").join(old.alias("o"), same, "left_anti").write.mode("append").partitionBy(_FOLDER).parquet(store)
        discard(new)
    else:
        new.write.mode("append").partitionBy(_FOLDER).parquet(store)


def review_inventory(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, status, length) of the listed files: included, missing, or skipped for size or kind."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    status = (
        F.when(F.col("length").isNull(), "missing")
        .when(ending.isin(*BINARY), "skipped_binary")
        .when(F.col("length") > PACKET_BYTES, "skipped_too_large")
        .otherwise("included")
    )
    return listed.select("path").join(files.select("path", "length"), "path", "left").select("path", status.alias("status"), F.coalesce("length", F.lit(0)).alias("length"))
