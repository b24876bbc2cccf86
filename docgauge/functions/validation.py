"""Why a request is refused before any model sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import strip

MOST_CHARS = 4000
MOST_BYTES = 12 * 1024 * 1024
MOST_PIXELS = 40_000_000


def refusal_reason(question: Column, cap: Column, size: Column, width: Column, height: Column, *, caps: tuple[int, ...] = (1, 4, 12)) -> Column:
    """The first reason to refuse, or null; a missing value is refused like a bad one.

    White space around a question does not count; an empty file is refused.
    """
    asked = strip(question)
    return (
        F.when(F.coalesce(asked == "", F.lit(True)), "blank_question")
        .when(F.length(asked) > MOST_CHARS, "long_question")
        .when(~F.coalesce(cap.isin(*caps), F.lit(False)), "tile_cap")
        .when(F.coalesce((size <= 0) | (size > MOST_BYTES), F.lit(True)), "file_size")
        .when(F.coalesce(width.cast("long") * height.cast("long") > MOST_PIXELS, F.lit(True)), "pixels")
    )
