import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.llm.mixture import allot, mixture
from docgauge.llm.mixture_queries import SQL as P7
from docgauge.llm.mixture_queries import p7_audit, p7_shares
from docgauge.llm import packing
from docgauge.llm.packing import pack, pack_items
from docgauge.llm.packing_queries import SQL as P6
from docgauge.llm.packing_queries import p6_audit
from docgauge.llm.tokens import VOCABULARY, _encoding, token_counts
from tests.oracle import assert_same, connect


def test_pack_fills_containers():
    rng = np.random.default_rng(3)
    for capacity in (64, 512, 2048):
        sizes = np.sort(np.minimum(rng.lognormal(5.5, 0.9, 3000).astype(int) + 1, capacity))[::-1]
        placed = pack(sizes, capacity)
        loads = np.bincount(placed, weights=sizes)
        assert loads.max() <= capacity and loads.min() > 0
        large = (sizes * 2 > capacity).sum()  # no two of these fit together
        assert len(loads) <= max(large, sizes.sum() / capacity) * 1.06 + 2
    assert list(pack(np.array([5, 5, 5]), 5)) == [0, 1, 2]
    assert len(pack(np.array([], dtype=int), 5)) == 0


def test_only_long_items_are_divided(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 1, 512, 513, 2000, 5000, 100, 100, 100])] * 1
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("capacity", F.lit(1)).withColumn("size", F.lit("x"))
    got = pack_items(df, "doc_id", "tokens", [("short", 512), ("long", 4096)], shard_pieces=3).collect()
    for window, capacity in (("short", 512), ("long", 4096)):
        parts = defaultdict(list)
        loads = Counter()
        for r in got:
            if r.window_name == window:
                parts[r.doc_id].append((r.token_from, r.tokens))
                loads[r.shard, r.container] += r.tokens
        assert max(loads.values()) <= capacity
        for doc, n in rows:
            if not n:
                assert doc not in parts
                continue
            spans = sorted(parts[doc])
            assert [a for a, _ in spans] == list(range(0, n, capacity)) and sum(t for _, t in spans) == n
            assert len(spans) == -(-n // capacity)
    assert pack_items(df.limit(0), "doc_id", "tokens", [("short", 512)]).count() == 0


def test_token_counts(spark):
    from pathlib import Path

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary")
    texts = ["Hello world", "", None, "<|endoftext|>", "año " * 20_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    found = {r.doc_id: r.tokens for r in token_counts(df.drop("tokens"), "text").collect()}
    encoding = _encoding(Path(VOCABULARY).read_bytes())
    assert found == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert encoding.decode(encoding.encode_ordinary("año")) == "año"


def test_allot_respects_repeats():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 4), ("zero", None, None)]
    shares = {s.source: s for s in allot(targets, {"a": 100_000, "b": 1_000_000, "c": 1_100}, block=1000)}
    assert shares["a"].planned == 100_000 and shares["c"].planned == 4_400 and shares["c"].blocks == 5 and shares["none"].planned == shares["zero"].blocks == 0
    assert sum(s.planned for s in shares.values()) == pytest.approx(1_101_100, abs=1000)
    plenty = {s.source: s.planned for s in allot(targets[:3], dict.fromkeys("abc", 10**6), block=1000, total=100_000)}
    assert plenty == {"a": 50_000, "b": 30_000, "c": 20_000}


def test_a_small_source_reaches_its_target_or_gives_all(spark):
    """A source of 1.1 blocks that may be repeated eight times, and one that is smaller than a block."""
    rows = [(i, "big", 700) for i in range(300)] + [(1000 + i, "small", 141) for i in range(4)] + [(2000, "tiny", 100), (2001, "tiny", 57)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = [("big", 0.97, 2), ("small", 0.02, 8), ("tiny", 0.01, 3)]
    have = {"big": 210_000, "small": 564, "tiny": 157}
    shares = {s.source: s for s in allot(targets, have, block=512)}
    assert (shares["small"].planned, shares["tiny"].planned) == (8 * 512, 3 * 157)
    got = mixture(df, list(shares.values()), block=512).collect()
    reached, times, slots = Counter(), Counter(), Counter()
    for r in got:
        reached[r.source] += r.tokens
        times[r.doc_id] += r.tokens
        slots[r.slot] += r.tokens
    total = sum(reached.values())
    assert reached == {s.source: s.planned for s in shares.values()}
    assert abs(reached["small"] - 0.02 * total) <= 512 and reached["tiny"] == 471
    assert times[2000] == 300 and times[2001] == 171
    assert sorted(slots) == list(range(sum(s.blocks for s in shares.values()))) and sum(n < 512 for n in slots.values()) <= 2


def test_mixture_uses_each_block_evenly(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice([0, 3, 50, 700, 4000])) for i in range(800)] + [(9000, "c", 10), (9001, None, 10), (9002, "unlisted", 10), (9003, "a", None)]
    rows += [rows[3], rows[3]]  # repeated rows are documents of their own
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("start", F.lit(1)).withColumn("bucket", F.lit(2))
    limits = {"a": 2, "b": 2, "c": 3}
    targets = [("a", 0.5, 2), ("b", 0.4, 2), ("c", 0.1, 3)]
    have = Counter()
    for _, s, t in rows:
        have[s] += t or 0
    shares = allot(targets, have, block=512)
    got = mixture(df, shares, block=512).collect()
    again = mixture(df.repartition(5), shares, block=512)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
    reached, slots = Counter(), defaultdict(int)
    spans = defaultdict(list)
    for r in got:
        reached[r.source] += r.tokens
        slots[r.slot] += r.tokens
        assert r.repeat_no < limits[r.source]
        spans[r.doc_id, r.repeat_no].append((r.token_from, r.token_from + r.tokens))
    assert reached == {s.source: s.planned for s in shares} and reached["c"] == 30
    assert max(slots.values()) == 512 and sorted(slots) == list(range(sum(s.blocks for s in shares)))
    once = {i: t for i, s, t in rows if s == "b" and t and i != rows[3][0]}
    assert all(sorted(spans[i, 0])[-1][1] == t and sum(b - a for a, b in spans[i, 0]) == t for i, t in once.items())
    # any stretch of the schedule is near the weights
    order = {r.slot: r.source for r in got}
    for begin in range(0, len(order) - 100, 100):
        part = sum(order[k] == "a" for k in range(begin, begin + 100)) / 100
        assert abs(part - shares[0].blocks / len(order)) < 0.06
    assert mixture(df.limit(0), allot(targets, {}, block=512), block=512).count() == 0


def test_shares_of_the_test_tables(spark, data):
    from pathlib import Path

    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary")
    rows = p7_shares(spark, data).collect()
    free = [r for r in rows if r.tokens < r.most_tokens]
    total = sum(r.tokens for r in rows)
    for r in rows:
        assert r.tokens == r.planned_tokens <= r.most_tokens and r.repeats <= r.max_repeats
        assert r.tokens == r.most_tokens or r.tokens >= r.target_share * sum(x.available_tokens for x in rows) - 512
    left = total - sum(r.tokens for r in rows if r not in free)
    for r in free:  # those that are not short share the rest in proportion
        assert abs(r.tokens - left * r.target_share / sum(x.target_share for x in free)) <= 1024 * len(free)


def test_every_container_is_tried():
    sizes, home = np.array([51] * 66 + [1] * 60), np.array([*range(66), *[66] * 60])
    cost = sizes.astype(float)
    packing._empty_thin(sizes, cost, home, np.array([49] * 66 + [40]), np.bincount(home, cost), 67, 100)
    assert 66 not in home and max(np.bincount(home, sizes)) <= 100


def test_costs_are_balanced():
    """Against packing in the order of arrival: nearly even costs, and emptying makes none dearer."""
    rng = np.random.default_rng(5)
    capacity = 4096
    sizes = np.sort(np.minimum(rng.lognormal(5.5, 0.9, 4000).astype(int) + 1, capacity // 4))[::-1]
    cost = packing.LINEAR * sizes + packing.QUADRATIC * sizes.astype(float) ** 2
    costs = np.bincount(pack(sizes, capacity), cost)
    assert costs.max() / costs.mean() < 1.1 and costs.std() / costs.mean() < 0.05
    shuffled, first, room = rng.permutation(len(sizes)), [0.0], capacity
    for i in shuffled:
        if sizes[i] > room:
            first.append(0.0)
            room = capacity
        first[-1] += cost[i]
        room -= sizes[i]
    assert costs.std() / costs.mean() < 0.3 * np.std(first) / np.mean(first)


def test_growth_splits_shards_in_two(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("tokens"))
    small = {r.doc_id: r.shard for r in pack_items(df.where("doc_id < 200"), "doc_id", "tokens", [("w", 512)], shard_pieces=100).collect()}
    large = {r.doc_id: r.shard for r in pack_items(df, "doc_id", "tokens", [("w", 512)], shard_pieces=100).collect()}
    assert max(small.values()) == 1 and max(large.values()) == 3 and all(large[i] & 1 == s for i, s in small.items())


@pytest.mark.parametrize(("query", "sql"), [(p6_audit, P6["p6_audit"]), (p7_audit, P7["p7_audit"])])
def test_audits_equal_sql(spark, data, query, sql):
    assert_same(query(spark, data), connect(data), sql)
