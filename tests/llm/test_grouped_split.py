import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docgauge.llm import grouped_split
from docgauge.llm.grouped_split import assign_splits, canonical_id, group_name, linked_groups, nameless
from docgauge.llm.grouped_split_queries import SQL, p5_audit, p5_found, p5_split
from docgauge.operators import skewed
from docgauge.session import table
from tests.oracle import assert_same, connect


def brute(mentions):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for r, e in mentions:
        if r is not None and e is not None:
            by[e].add(r)
    for rs in by.values():
        low = min(rs)
        for r in rs:
            a, b = find(low), find(r)
            parent[max(a, b)] = min(a, b)
    return {r: find(r) for rs in by.values() if len(rs) > 1 for r in rs}


@pytest.mark.parametrize("hot", [False, True])
def test_components_against_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skewed, "HOT_ROWS", 5)
        monkeypatch.setattr(skewed, "HOT_KEYS", 10)
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(150):03}", f"e{rng.randrange(200)}") for _ in range(220)] + [(f"c{i:02}", f"x{i // 2}") for i in range(20)] + [(f"c{i:02}", f"y{(i + 1) // 2}") for i in range(20)]
    rows += [(f"r{i:03}", "hub") for i in range(40)] + [(None, "e1"), ("r001", None), ("r001", "hub"), ("r001", "hub")]
    df = spark.createDataFrame(rows, "r string, e string")
    assert {r.r: r.label for r in linked_groups(df, "r", "e").collect()} == brute(rows)
    assert linked_groups(df.limit(0), "r", "e").count() == 0


def test_written_ids(spark):
    pairs = [("nftb1789", "nftb1789"), ("HMFP5417", "hmfp5417"), (" bfsm7216  ", "bfsm7216"), ("bbrb0720\xa0", "bbrb0720"), ("byny-9145", "byny9145"), ("bsdr 1281", "bsdr1281"), ("ucsf:bbrb0720", "bbrb0720"), ("bfdr0654.pdf", "bfdr0654"), ("UCSF_BGXG9223_p4", "bgxg9223"), ("https://docs.archive.example/byvf8712/", "byvf8712"), ("ddh​s1793", "ddhs1793"), ("ｆｗｂｙ４１１１", "fwby4111"), ("fwby4lll", "fwby4111"), ("hzgj32O8", "hzgj3208"), ("unknown", None), ("n/a", None), ("None", None), ("-", None), ("", None), (None, None)]
    df = spark.createDataFrame(pairs, "w string, c string")
    assert [r[0] for r in df.select(canonical_id(F.col("w"))).collect()] == [c for _, c in pairs]
    numbers = spark.createDataFrame([(5,), (-3,), (10**12,), (None,)], "d long")
    labels = [tuple(r) for r in numbers.select(nameless(F.col("d")), group_name(nameless(F.col("d")))).collect()]
    assert [b for _, b in labels] == ["doc:5", "doc:-3", f"doc:{10**12}", None]
    assert labels[1][0] < labels[0][0] < labels[2][0]


def test_found_equals_sql(spark, data):
    assert_same(p5_found(spark, data), connect(data), SQL["p5_found"])


def test_split_keeps_groups_whole_and_near_targets(spark, data):
    rows = p5_split(spark, data).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.group_key].add(r.split_name)
    assert all(len(s) == 1 and None not in s for s in by.values())
    assert len(rows) == table(spark, data, "internvl_error_sample_v1").select("question_id").distinct().count()


def test_audit_equals_sql(spark, data):
    assert_same(p5_audit(spark, data), connect(data), SQL["p5_audit"])


def drift(rows, shares):
    """Largest distance of a split's size, and of a label's share in a split, from its target; parts of all records."""
    sizes, labels = Counter(r.split_name for r in rows), Counter(r.s for r in rows)
    both = Counter((r.split_name, r.s) for r in rows)
    return max(abs(sizes[k] - share * len(rows)) for k, share in shares) / len(rows), max(abs(both[k, s] - share * n) for k, share in shares for s, n in labels.items()) / len(rows)


@pytest.mark.parametrize(("size", "part"), [(3000, grouped_split.CLASS_PART), (150, 1 / 8), (3000, 2.0)])
def test_assignment_balances_sizes_and_labels(spark, monkeypatch, size, part):
    monkeypatch.setattr(grouped_split, "CLASS_PART", part)
    rng = random.Random(4)
    rows = []
    for g in range(size):
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((f"g{g}", rng.choice("aab"), len(rows)))
    rows += [("big", "b", 10**6 + i) for i in range(size // 5)] + [(None, None, 10**7), (None, "a", 10**7 + 1)]
    df = spark.createDataFrame(rows, "g string, s string, id long").withColumn("n", F.lit(0)).withColumn("size", F.lit("x")).withColumn("split_name", F.lit("clash"))
    shares = [("test", 0.1), ("train", 0.8), ("validation", 0.1)]
    got = assign_splits(df, shares, group="g", stratum="s").collect()
    again = {r.id: r.split_name for r in assign_splits(df.repartition(9), shares, group="g", stratum="s").collect()}
    assert len(got) == len(rows) and again == {r.id: r.split_name for r in got}
    where = defaultdict(set)
    for r in got:
        where[r.g].add(r.split_name)
    assert all(len(s) == 1 and None not in s for s in where.values())
    by_size, by_label = drift(got, shares)
    if part < 1:
        assert by_size < 0.015 and by_label < 0.03
    assert assign_splits(df.limit(0), shares, group="g", stratum="s").count() == 0


def test_rare_labels_are_put_together(spark):
    """Any number of labels: the list on the driver is bounded."""
    df = spark.range(4000).select((F.col("id") / 2).cast("int").cast("string").alias("g"), F.concat(F.lit("w"), F.col("id") % 700).alias("s"), "id")
    shares = [("train", 0.8), ("test", 0.2)]
    got = assign_splits(df, shares, group="g", stratum="s").collect()
    assert len(got) == 4000 and drift(got, shares)[0] < 0.01
