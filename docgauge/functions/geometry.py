"""Tile counts and sizes of page images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_ratios(most: int, least: int = 1) -> list[tuple[int, int]]:
    """All (columns, rows) with ``least`` to ``most`` tiles, by area, then columns, then rows."""
    grid = [(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most]
    return sorted(grid, key=lambda r: (r[0] * r[1], r[0], r[1]))


def tile_grid(width: Column, height: Column, most: int, size: int = 448) -> Column:
    """struct(columns, rows): the nearest aspect ratio.

    Candidates are folded in order; of equally near ones a later one wins
    only if the image has more than half the pixels of its tiles.
    """
    ratios = F.array(*[F.struct(F.lit(i).alias("columns"), F.lit(j).alias("rows")) for i, j in tile_ratios(most)])
    aspect, area = width / height, width.cast("double") * height
    start = F.struct(F.lit(float("inf")).alias("gap"), F.lit(1).alias("columns"), F.lit(1).alias("rows"))

    def step(best: Column, ratio: Column) -> Column:
        gap = F.abs(aspect - ratio["columns"] / ratio["rows"])
        large = area > F.lit(0.5 * size * size) * ratio["columns"] * ratio["rows"]
        wins = (gap < best["gap"]) | ((gap == best["gap"]) & large)
        return F.when(wins, F.struct(gap.alias("gap"), ratio["columns"].alias("columns"), ratio["rows"].alias("rows"))).otherwise(best)

    return F.aggregate(ratios, start, step, lambda b: F.struct(b["columns"].alias("columns"), b["rows"].alias("rows")))


def tile_count(width: Column, height: Column, most: int, size: int = 448, *, thumbnail: bool = True) -> Column:
    """Tiles of an image, with one for the thumbnail if there are several."""
    grid = tile_grid(width, height, most, size)
    tiles = grid["columns"] * grid["rows"]
    return F.when((tiles > 1) & F.lit(thumbnail), tiles + 1).otherwise(tiles)


def candidate_caps(most: int, least: int = 1) -> list[int]:
    """Tile caps to compare: the full one first, then descending."""
    return sorted({c for c in (1, min(4, most), most) if c >= least}, reverse=True)


def visual_tokens(tiles: Column, per_tile: int = 256) -> Column:
    return tiles * F.lit(per_tile)


def aspect_log(width: Column, height: Column) -> Column:
    return F.log(F.greatest(width, F.lit(1)) / F.greatest(height, F.lit(1)))


def thumbnail_box(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """struct(width, height) that fits the box at the same aspect, at least 1 pixel, never enlarged."""
    scale = F.least(F.lit(most_width) / width, F.lit(most_height) / height, F.lit(1.0))
    side = lambda c: F.greatest(F.lit(1), F.rint(c * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def gib(size: Column) -> Column:
    return size / F.lit(float(1024**3))


def run_hours(per_update: Column, updates: int = 200, seeds: int = 3, questions: int = 208, seconds: float = 3.5, runs: int = 4) -> Column:
    """Estimated hours of training and evaluation runs."""
    return (per_update * F.lit(updates * seeds) + F.lit(questions * seconds * runs)) / F.lit(3600.0)
