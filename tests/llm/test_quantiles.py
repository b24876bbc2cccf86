import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.llm.quantile_queries import p2_bounds, p2_found
from docgauge.llm.quantile_queries import SQL
from docgauge.llm.quantiles import Compactors, build_sketches, latency_values, merge_sketches, quantile, rank_error, share
from tests.oracle import assert_same, connect


def test_rank_error_holds_and_weights_add_up():
    rng = np.random.default_rng(1)
    values = rng.lognormal(size=200_000)
    parts = []
    for chunk in np.array_split(values, 40):
        state = Compactors(128, len(parts))
        for piece in np.array_split(chunk, 7):
            state.update(piece)
        parts.append(state.row())
    merged = Compactors(128, "all")
    for part in parts:
        merged.merge(*part)
    n, shift, levels = merged.row()
    assert n == len(values) == sum(len(x) << h for h, x in enumerate(levels))
    assert sum(map(len, levels)) < 2_000
    bound = np.sqrt(2 * shift * np.log(2 / 1e-6)) / n
    assert bound < 0.06
    for q in np.linspace(0.01, 0.99, 25):
        x = np.quantile(values, q)
        assert abs(sum((np.asarray(v) < x).sum() << h for h, v in enumerate(levels)) / n - (values < x).mean()) <= bound


def test_equal_parts_do_not_err_alike():
    """Coins do not depend on the values: errors of equal parts cancel out."""
    values = np.arange(1000.0)
    worst = []
    for trial in range(6):
        merged = Compactors(64, ("all", trial))
        for part in range(400):
            state = Compactors(64, ("g", trial, part))
            state.update(values)
            merged.merge(*state.row())
        n, shift, levels = merged.row()
        bound = np.sqrt(2 * shift * np.log(2 / 1e-6)) / n
        worst.append(max(abs(sum((np.asarray(v) < x).sum() << h for h, v in enumerate(levels)) / n - x / 1000) for x in range(50, 1000, 50)) / bound)
    assert max(worst) < 0.7
    tossed = [Compactors(8, i).coin() for i in range(2000)]
    assert abs(np.mean(tossed) - 0.5) < 0.05
    again = Compactors(8, "x"), Compactors(8, "x")
    assert [again[0].coin() for _ in range(600)] == [again[1].coin() for _ in range(600)]


def test_many_sketches_are_merged_in_a_tree(spark):
    df = spark.range(30_000).select((F.col("id") % 500).alias("day"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("s"), (F.col("id") * 7919 % 30_000).cast("double").alias("x"))
    days = merge_sketches(build_sketches(df, ["s", "day"], "x", capacity=32), ["s", "day"], capacity=32)
    tree = {r.s: r for r in merge_sketches(days, ["s"], capacity=256, fan_in=4).select("s", "n", quantile(0.5).alias("m"), rank_error().alias("e")).collect()}
    assert (tree["hot"].n, tree[None].n) == (20_000, 10_000)
    for r in tree.values():
        assert 0 < r.e < 0.1 and abs(r.m / 30_000 - 0.5) <= r.e + 0.01


def test_stated_bounds_hold_on_the_log(spark, data):
    assert_same(p2_bounds(spark, data), connect(data), SQL["p2_bounds"])


@pytest.mark.parametrize("parts", [1, 6])
def test_small_groups_are_exact_and_odd_values_are_left_out(spark, parts):
    rows = [("a", 1, float(i)) for i in range(101)] + [("a", 1, None), ("a", 1, float("nan")), (None, 2, 5.0), (None, 2, 5.0), ("b", None, float("inf")), ("b", None, -1.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double").withColumn("extra", F.lit(1)).repartition(parts)
    kept = merge_sketches(build_sketches(df, ["g", "h"], "x"), ["g", "h"])
    found = {(r.g, r.h): r for r in kept.select("g", "h", "n", quantile(0.5).alias("m"), rank_error().alias("e"), share(F.lit(50.0), inclusive=False).alias("l"), share(F.lit(50.0), inclusive=True).alias("u")).collect()}
    assert (found["a", 1].n, found["a", 1].m, found["a", 1].e) == (101, 50.0, 0.0)
    assert (found["a", 1].l, found["a", 1].u) == pytest.approx((50 / 101, 51 / 101))
    assert (found[None, 2].n, found[None, 2].m) == (2, 5.0)
    assert (found["b", None].n, found["b", None].m) == (2, -1.0)
    assert merge_sketches(build_sketches(df.limit(0), ["g"], "x"), ["g"]).count() == 0


def test_longer_spans_follow_from_kept_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.lit(1).alias("s"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x")).repartition(5)
    days = merge_sketches(build_sketches(df, ["s", "day"], "x", capacity=256), ["s", "day"], capacity=256)
    whole = merge_sketches(days, ["s"], capacity=256).select("n", quantile(0.5).alias("m"), quantile(0.95).alias("p"), rank_error().alias("e")).first()
    assert whole.n == 60_000 and 0 < whole.e < 0.03
    assert abs(df.where(F.col("x") < whole.m).count() / 60_000 - 0.5) <= whole.e + 0.001
    assert abs(df.where(F.col("x") < whole.p).count() / 60_000 - 0.95) <= whole.e + 0.001


def test_found_equals_sql(spark, data):
    assert_same(p2_found(spark, data), connect(data), SQL["p2_found"])


def test_copies_of_a_record_count_once(spark):
    kind = "record_id long, run_tag string, system string, eval_day date, status string, is_warmup boolean, generation_seconds double"
    rows = [(1, "r", "s", None, "ok", False, 1.0)] * 3 + [(2, "r", "s", None, "ok", True, 1.0), (3, "r", "s", None, "error", False, 1.0), (4, "r", "s", None, "ok", False, -1.0), (5, "r", "s", None, "ok", False, float("inf")), (6, "r", "s", None, "ok", False, None), (7, "r", "s", None, None, None, float("nan"))]
    assert latency_values(spark.createDataFrame(rows, kind)).count() == 1
