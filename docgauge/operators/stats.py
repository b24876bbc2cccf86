"""Percentiles, histograms, trends over ordered series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.numbering import numbered

#: Values that agree in this many parts of a natural logarithm share a bucket.
BUCKETS = 256


def exact_sum(value: Column) -> Column:
    """Sum of doubles that is the same in every order of the rows.

    Doubles are added as decimals of 20 places, since the last digit of a sum of
    doubles, and with it the rounding of a mean that lies halfway, depends on
    how rows are spread.  Values of a million or more, infinities and NaN are
    added as doubles.  Null values take no part.
    """
    small = F.abs(value) < 1e6
    exact = F.sum(F.when(small, value.cast("decimal(27,20)"))).cast("double")
    large = F.sum(F.when(~small, value))
    return F.coalesce(exact + large, exact, large)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at places (0-based, as functions of the count) in each group's order.

    Null and NaN values take no part.  Rows are first counted by value, then by
    buckets of near values; only the buckets that hold a wanted place are
    ordered, each in a task.  A task so sees the distinct values of one bucket
    of a group, those within a 1/``BUCKETS`` of a logarithm, and never its rows.
    """
    bucket = F.floor(F.asinh(F.col(value)) * BUCKETS).alias("__b")
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = clean.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).select(*by, value, "__n", bucket)
    ordered = Window.partitionBy(*by).orderBy("__b")
    buckets = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__size"))
    buckets = buckets.withColumn("__end", F.sum("__size").over(ordered)).withColumn("__total", F.sum("__size").over(Window.partitionBy(*by)))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), place(F.col("__total")).cast("long").alias("at")) for k, place in places.items()]))
    wanted = buckets.select(*by, "__b", "__end", "__size", named.alias("__w")).select(*by, "__b", "__w.name", (F.col("__w.at") - F.col("__end") + F.col("__size")).alias("at"), "__size")
    wanted = wanted.where((F.col("at") >= 0) & (F.col("at") < F.col("__size")))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*by, "__b"]]
    near = counts.alias("c").join(wanted.alias("w"), same).select("c.*", "w.name", "w.at")
    upto = F.sum("__n").over(Window.partitionBy(*by, "__b", "name").orderBy(value))
    reached = near.withColumn("__upto", upto).where(F.col("__upto") > F.col("at"))
    return reached.groupBy(*by).agg(*[F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in places])


def percentiles_linear(df: DataFrame, by: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles, interpolated between the neighbours of place p * (n - 1)."""
    places: dict[str, Callable[[Column], Column]] = {}
    for k, p in ps.items():
        places[f"{k}__low"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        places[f"{k}__high"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    found = order_statistics(df, by, value, places)
    sizes = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    both = found.alias("f").join(sizes.alias("s"), [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by])
    part = {k: F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1)) for k, p in ps.items()}
    return both.select(*[F.col(f"f.{k}") for k in by], *[(F.col(f"{k}__low") + (F.col(f"{k}__high") - F.col(f"{k}__low")) * part[k]).alias(k) for k in ps])


def percentiles_nearest(df: DataFrame, by: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact values at place round(p * (n - 1)), halves to even."""
    return order_statistics(df, by, value, {k: (lambda n, p=p: F.rint(F.lit(p) * (n - 1))) for k, p in ps.items()})


def histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


#: Rows of a series that are averaged, or counted through, in one task.
STRETCH = 1 << 16


def trailing_mean(series: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, size: int = 20) -> DataFrame:
    """``series`` with the mean of the last ``size`` rows, null until there are so many.

    Series are cut into stretches; each is given the last rows of the one before.
    """
    placed = numbered(series, by, order).withColumn("__s", F.expr(f"__place div {STRETCH}"))
    # a row near the end of a stretch also stands, as a guest, before the next one
    homes = F.when(F.col("__place") % STRETCH > STRETCH - size, F.array("__s", F.col("__s") + 1)).otherwise(F.array("__s"))
    wide = placed.withColumn("__home", F.explode(homes))
    frame = Window.partitionBy(*by, "__home").orderBy("__place").rowsBetween(1 - size, 0)
    mean = F.when((F.col("__place") >= size - 1) & (F.count(F.lit(1)).over(frame) == size), F.avg(value).over(frame))
    return wide.withColumn(name, mean).where(F.col("__home") == F.col("__s")).drop("__home", "__s", "__place")


def end_means(series: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int = 20) -> DataFrame:
    """Means of the first and of the last ``size`` rows; null for shorter series.

    Either end is cut off by a rank, so groups are limited before the shuffle.
    """
    up = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.asc(c) for c in order]))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))

    def end(rank: Column, name: str) -> DataFrame:
        kept = series.select(*by, *order, value).withColumn("__rank", rank).where(F.col("__rank") <= size)
        return kept.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= size, F.avg(value)).alias(name))

    first, last = end(up, "first_mean").alias("f"), end(down, "last_mean").alias("l")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in by]
    return first.join(last, same).select(*[F.col(f"f.{k}") for k in by], "first_mean", "last_mean")


def tumbling_mean(series: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int = 8) -> DataFrame:
    """Mean of each run of ``size`` rows in order; the last one may be shorter."""
    stepped = numbered(series, by, order).withColumn("step", F.expr(f"__place div {size} + 1"))
    return stepped.groupBy(*by, "step").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def seen_so_far(by: Sequence[str], order: Sequence[str], item: str, rows: DataFrame) -> DataFrame:
    """``rows`` with samples_seen and unique_seen up to each row.

    The first rows of the items are found by an aggregate; their flags are
    summed inside stretches of the series, and over the stretches.
    """
    placed = numbered(rows, by, order)
    firsts = placed.groupBy(*by, item).agg(F.min("__place").alias("__place")).select(*by, "__place", F.lit(1).alias("__first"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*by, "__place"]]
    marked = placed.alias("p").join(firsts.alias("f"), same, "left").select("p.*", F.coalesce("f.__first", F.lit(0)).cast("long").alias("__first"))
    marked = marked.withColumn("__s", F.expr(f"__place div {STRETCH}"))
    totals = marked.groupBy(*by, "__s").agg(F.sum("__first").alias("__t"))
    before = totals.select(*by, "__s", (F.sum("__t").over(Window.partitionBy(*by).orderBy("__s")) - F.col("__t")).alias("__o"))
    inside = F.sum("__first").over(Window.partitionBy(*by, "__s").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    summed = marked.withColumn("__u", inside).alias("m").join(before.alias("b"), [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "__s"]])
    return summed.select(*[F.col(f"m.`{c}`") for c in rows.columns], (F.col("m.__place") + 1).alias("samples_seen"), (F.col("m.__u") + F.col("b.__o")).alias("unique_seen"))


def is_contiguous(step: Column) -> Column:
    """Aggregate: whether the steps are 1 to n, each once."""
    return (F.min(step) == 1) & (F.max(step) == F.count(F.lit(1))) & (F.count_distinct(step) == F.count(F.lit(1)))


def spread(value: Column) -> list[Column]:
    """Aggregates: mean, sample deviation (null for one value), least, greatest."""
    return [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest")]
