"""The metrics of one answer as one native struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgauge.functions import text

def stored_metric(rows: DataFrame, names: Sequence[str], *, default: float | None = 0.0) -> Column:
    """The first of the stored scores ``names`` that a row has, in ``metrics``, in ``scores``, or of its own.

    Layouts differ from one log to another: columns that are not there are
    passed over.  A score of 0 is a score; ``default`` stands for none, null if
    it is None.
    """
    held = {c: {f.name for f in rows.schema[c].dataType.fields} for c in ("metrics", "scores") if c in rows.columns and isinstance(rows.schema[c].dataType, StructType)}
    found = [F.col(c)[n] for n in names for c in held if n in held[c]] + [F.col(f"`{n}`") for n in names if n in rows.columns]
    return F.coalesce(*[c.cast("double") for c in found], F.lit(default).cast("double"))


PRIMARY = ("strict", "inclusive", "raw_length")


def metrics(prediction: Column, references: Column, status: Column, *, primary: str = "strict") -> Column:
    """Struct of all scores; an answer that is null or not ok scores 0 and is a failure.

    An unknown ``primary`` means the strict one.
    """
    good = F.coalesce((status == "ok") & prediction.isNotNull(), F.lit(False))
    zero = F.lit(0.0)
    chosen = primary if primary in PRIMARY else "strict"
    # one array of one struct, or of a null one: no distance is computed for what failed
    scores = F.when(good, text.similarities(prediction, references))

    def named(s: Column) -> Column:
        return F.struct(
            F.coalesce(s[chosen], zero).alias("primary"),
            *[F.coalesce(s[k], zero).alias(k) for k in PRIMARY],
            F.when(good, text.exact(prediction, references)).otherwise(zero).alias("exact_match"),
            good.alias("scored"),
            (~good).alias("failure"),
            (F.size(text.valid_references(references)) == 0).alias("invalid_references"),
        )

    return text.bind(scores, named)
