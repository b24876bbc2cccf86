import math
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from docgauge.functions.digests import canonical_json_digest, fingerprint, verified
from docgauge.operators import skewed
from docgauge.operators.bootstrap import attachable, cluster_bootstrap
from docgauge.operators.compare import agreement, mismatches, paired
from docgauge.operators.coverage import enforce, last_by_key, missing_keys, repeated_keys, required_set, requested_set_summary, sidecar_report, unexpected_keys
from docgauge.operators.deliveries import one_per_message, surplus_deliveries
from docgauge.operators.leakage import exclusion_reasons, overlap_counts
from docgauge.operators.neighbors import nearest_donors
from docgauge.operators.resume import guard_append, guard_hardware, incoherent_runs, pending, run_states, weight_sets
from docgauge.operators.sampling import presented, spread_evenly, take_groups, take_per_group
from docgauge.operators.stats import exact_sum
from docgauge.queries import comparison, evidence, resampling

SENT = "key long, at long, id long, payload string"


def brute_surplus(rows):
    groups = defaultdict(list)
    for key, at, id_, _ in rows:
        if key is not None:
            groups[key].append((at is None, at or 0, id_))
    return sorted(id_ for g in groups.values() for _, _, id_ in sorted(g)[1:])


@pytest.mark.parametrize("hot", [False, True])
def test_deliveries_against_brute_force(spark, monkeypatch, hot):
    if hot:  # a key with a third of the rows is ranked in salted pieces
        monkeypatch.setattr(skewed, "HOT_ROWS", 5)
        monkeypatch.setattr(skewed, "HOT_KEYS", 10)
    rng = random.Random(5)
    rows = [(rng.choice([7, None, rng.randrange(200), 7, rng.randrange(5)]), rng.choice([None, rng.randrange(4)]), i, "x" * rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, SENT)
    found = [r.id for r in surplus_deliveries(df, "key", ["at", "id"]).collect()]
    assert sorted(found) == brute_surplus(rows)
    kept = one_per_message(df.repartition(7), "key", ["at", "id"]).collect()
    assert sorted(r.id for r in kept) == sorted(set(range(600)) - set(found))
    assert set(kept[0].asDict()) == {"key", "at", "id", "payload"}


def test_deliveries_edges(spark):
    empty = spark.createDataFrame([], SENT)
    assert surplus_deliveries(empty, "key", ["at", "id"]).count() == 0
    assert one_per_message(empty, "key", ["at", "id"]).count() == 0
    same = spark.createDataFrame([(1, 1, 1, "a")] * 3 + [(None, 1, 2, None)] * 2, SENT)
    assert surplus_deliveries(same, "key", ["at", "id"]).count() == 2
    assert one_per_message(same, "key", ["at", "id"]).count() == 3
    stored = one_per_message(same, "key", ["at", "id"])
    more = spark.createDataFrame([(1, 0, 9, "early"), (2, 5, 4, "new")], SENT)
    ids = {(r.key, r.id) for r in one_per_message(more, "key", ["at", "id"], stored=stored).collect() if r.key}
    assert ids == {(1, 9), (2, 4)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(skewed, "HOT_ROWS", 3)
    monkeypatch.setattr(skewed, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 20 + [2] * 30 + [3, 4, None, None, 5])], "k long, i long")
    table = spark.createDataFrame([(1, "a"), (3, None), (5, "e")], "k long, v string")
    want = sorted(map(tuple, rows.join(table, "k", how).select("k", "i", "v").collect()), key=repr)
    assert sorted(map(tuple, skewed.lookup(rows, table, "k", spread=["i"], how=how).select("k", "i", "v").collect()), key=repr) == want


def test_required_sets(spark):
    with pytest.raises(ValueError, match="repeated"):
        required_set(spark.createDataFrame([(1,), (1,)], "question_id long"), "question_id")
    with pytest.raises(ValueError, match="not 3"):
        required_set(spark.createDataFrame([(1,), (2,)], "question_id long"), "question_id", size=3)
    required = spark.createDataFrame([(1,), (2,), (3,), (4,)], "q long")
    rows = spark.createDataFrame([(1, True, 1.0, 1.0), (2, False, 0.9, 1.0), (4, True, 0.5, 0.0)], "q long, good boolean, s double, e double")
    r = requested_set_summary(rows, F.lit(required.count()), [], ok=F.col("good"), score=F.col("s"), exact=F.col("e")).first()
    assert (r.n_ok, r.n_failed, r.n_missing, r.mean_score, r.mean_exact) == (2, 1, 1, 1.5 / 4, 1 / 4)
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (99, 1, "c")], "q long, at long, t string")
    assert {(r.q, r.t) for r in last_by_key(log, ["q"], ["at"]).collect()} == {(1, "b"), (99, "c")}
    assert [r.q for r in repeated_keys(log, ["q"]).collect()] == [1]
    assert [r.q for r in unexpected_keys(log, required, "q").collect()] == [99]
    assert sorted(r.q for r in missing_keys(log, required, "q").collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="bad"):
        enforce(log, "bad")


def test_sidecar_report(spark):
    required = spark.createDataFrame([(1,), (2,)], "question_id long")
    answers = spark.createDataFrame([(1, True), (1, True), (3, True)], "question_id long, ok boolean")
    assert {tuple(r) for r in sidecar_report(required, answers, F.col("ok")).collect()} == {(1, "repeated"), (2, "missing"), (3, "extra")}
    blank = spark.createDataFrame([(1, False)], "question_id long, ok boolean")
    assert (1, "invalid") in {tuple(r) for r in sidecar_report(required, blank, F.col("ok")).collect()}


def test_agreement_needs_two_ok_records(spark):
    rows = [(None, None, None, None), ("error", "a", "error", "a"), ("ok", "hello", None, None), ("ok", "hello", "ok", "Hello "), ("ok", "hello", "ok", "other")]
    df = spark.createDataFrame(rows, "a string, x string, b string, y string")
    assert [r[0] for r in df.select(agreement(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == [None, None, None, True, False]


def test_paired_counts_missing_as_zero(spark):
    required = spark.createDataFrame([(1,), (2,)], "q long")
    a = spark.createDataFrame([(1, 1.0)], "q long, s double")
    assert {(r.q, r.delta) for r in paired(required, a, a.limit(0), "q", "s").collect()} == {(1, -1.0), (2, 0.0)}
    left = spark.createDataFrame([(1, "a", None)], "q long, x string, y string")
    right = spark.createDataFrame([(1, "b", None)], "q long, x string, y string")
    assert [tuple(r) for r in mismatches(left, right, "q", ["x", "y"]).collect()] == [(1, "x")]


def test_sampling_ignores_partitioning(spark):
    rows = spark.createDataFrame([(f"g{i % 17}", i) for i in range(300)], "g string, k long")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"))
    first = sorted(r.g for r in take_groups(groups, "g", "n", F.lit(100), 1).collect())
    assert first == sorted(r.g for r in take_groups(groups.repartition(9), "g", "n", F.lit(100), 1).collect())
    assert sum(r.n for r in take_groups(groups, "g", "n", F.lit(100), 1).collect()) >= 100
    assert take_per_group(rows, "g", "k", 4, 1).groupBy("g").count().where("count > 4").isEmpty()
    assert [r.k for r in spread_evenly(rows.select("k"), "k", 4).orderBy("slot").collect()] == [0, 100, 199, 299]
    order = [r.k for r in presented(rows.select("k").limit(3), "k", 7 / 3).orderBy("step").collect()]
    assert len(order) == 7 and order[:3] == order[3:6]


def test_exclusions_take_the_first_reason(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c")], "q long, d string")
    marked = exclusion_reasons(rows, {"none": F.col("d").isNull(), "q": ("q", spark.createDataFrame([(2,), (3,), (None,)], "x long")), "d": ("d", spark.createDataFrame([("b",), ("c",), ("c",)], "x string"))})
    assert {(r.q, r.reason) for r in marked.collect()} == {(1, None), (2, "none"), (3, "q"), (4, "d")}
    found = overlap_counts(rows, rows.where("q < 4"), {"q": F.col("q"), "d": F.col("d")})
    assert {tuple(r) for r in found.collect()} == {("q", 3), ("d", 2)}


@pytest.mark.parametrize(("width", "kinds"), [(4, ["x", "y", None]), (64, ["x", "y", None]), (2, ["x"] * 9 + ["y"])])
def test_nearest_donor_against_brute_force(spark, width, kinds):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, round(rng.uniform(-3, 3), 1), 7.0]), rng.choice(kinds)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, v double, d string").withColumn("at", F.lit(1)).withColumn("home", F.lit(2))
    found = {r.k: r.donor for r in nearest_donors(df, "k", "v", ["d"], width=width).collect()}
    assert nearest_donors(df.where("v IS NULL"), "k", "v", ["d"]).count() == 0
    for k, v, d in rows:
        if v is None:
            assert k not in found
            continue
        allowed = [(abs(v - w), j) for j, w, e in rows if w is not None and (d is None or e is None or d != e)]
        assert found[k] == (min(allowed)[1] if allowed else None)


def test_bootstrap_keeps_multiplicity_and_binds_inputs(spark):
    scores = spark.createDataFrame([("g1", 1.0, 0.0), ("g1", 1.0, 0.0), ("g2", 0.0, 1.0)], "g string, a double, b double")
    r = cluster_bootstrap(scores, "g", "a", "b", replicates=200, seed=1).first()
    assert r.observed == pytest.approx(-1 / 3) and r.low == pytest.approx(-1.0) and r.high == pytest.approx(1.0) and r.replicates == 200
    assert attachable({}, {"scores_digest": "a", "groups_digest": "b"})[0] is False
    assert attachable({"scores_digest": "a", "groups_digest": "b"}, {"scores_digest": "a", "groups_digest": "b"})[0]
    assert not attachable({"scores_digest": "x", "groups_digest": "b"}, {"scores_digest": "a", "groups_digest": "b"})[0]


def test_resume(spark):
    log = spark.createDataFrame([(1, "ok", "f"), (2, "error", "f"), (3, "ok", "other")], "q long, status string, p string")
    required = spark.createDataFrame([(1,), (2,), (3,), (4,)], "q long")
    assert sorted(r.q for r in pending(required, log, "q", "p", "f").collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="fingerprint"):
        guard_append(log, "p", "f")
    guard_append(log.limit(0), "p", "f")
    assert incoherent_runs(log.withColumn("r", F.lit(1)), ["r"], "p").count() == 1


def test_digests():
    a = {"b": 1, "a": "é", "manifest_sha256": "x"}
    assert canonical_json_digest(a, drop=("manifest_sha256",)) == canonical_json_digest({"a": "é", "b": 1})
    a["manifest_sha256"] = canonical_json_digest(a, drop=("manifest_sha256",))
    assert verified(a)["ok"] and not verified({**a, "b": 2})["ok"]
    assert fingerprint({"x": 1})["run_fingerprint_sha256"] != fingerprint({"x": 2})["run_fingerprint_sha256"]


def test_fingerprints_have_a_contract(spark):
    from docgauge.functions import digests, scoring, text

    settings = {f: f for f in digests.INFERENCE_FIELDS if f not in digests.OPTIONAL_FIELDS}
    one = digests.inference_fingerprint(**settings)
    assert len(one) == 21 and one["perturbation"] is None and one["run_fingerprint_sha256"] != digests.inference_fingerprint(**settings, train_update=100)["run_fingerprint_sha256"]
    with pytest.raises(ValueError, match="missing"):
        digests.inference_fingerprint(model_id="x")
    with pytest.raises(ValueError, match="unknown"):
        digests.inference_fingerprint(**settings, colour="red")
    scorer = digests.source_digest(text, scoring)
    assert len(scorer) == 64 and scorer != digests.source_digest(scoring, text)
    assert digests.scoring_provenance("strict", "a", scorer)["scoring_schema"] == "scoring_v2"
    assert digests.verified({"a": 1}, raw=b"{}")["raw"] == digests.hashlib.sha256(b"{}").hexdigest()
    row = {"b": 'q"uote\n', "a": 3, "c": None, "d": True}
    df = spark.createDataFrame([(row["b"], row["a"], row["c"], row["d"])], "b string, a int, c string, d boolean")
    assert df.select(digests.json_digest({k: F.col(k) for k in row})).first()[0] == canonical_json_digest(row, newline=False)


def test_run_states_and_hardware(spark):
    log = spark.createDataFrame([("a", 1, "f"), ("a", 2, "f"), ("b", 3, "f"), ("b", 4, "g"), ("c", 5, "f"), ("d", 6, "f"), ("d", 7, "f"), ("d", 7, None)], "run string, r long, p string")
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1)], "run string, expected int")
    states = {r.run: (r.state, r.problems) for r in run_states(log, wanted, ["run"], "r", "p").collect()}
    assert states == {"a": ("ok_complete", ""), "b": ("incompatible", "fingerprints"), "c": ("incompatible", "too few"), "d": ("incompatible", "fingerprints,too many"), "e": ("missing", "")}
    kinds = {r.run: (r.kinds, r.as_wanted) for r in weight_sets(log, wanted.withColumn("wanted", F.lit("f")), ["run"], "p").collect()}
    assert kinds["a"] == (1, True) and kinds["b"] == (2, False) and kinds["d"] == (1, False)
    machines = spark.createDataFrame([("x",), (None,)], "gpu string")
    guard_hardware(machines, "gpu", "x")
    guard_hardware(machines, "gpu", "y", allow_mixed=True)
    with pytest.raises(ValueError, match="hardware"):
        guard_hardware(machines, "gpu", "y")


def test_trends_over_stretches(spark, monkeypatch):
    """Series longer than a stretch, with ties, nulls and a null series, against plain loops."""
    from docgauge.operators import stats

    monkeypatch.setattr(stats, "STRETCH", 16)
    rng = random.Random(9)
    rows = [(s, i, rng.choice(["a", "b", f"c{i}"]), rng.random()) for s, n in (("long", 101), ("short", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, item string, x double").repartition(7)
    trailing = {(r.s, r.i): r.t for r in stats.trailing_mean(df, ["s"], ["i"], "x", "t", 7).collect()}
    seen = {(r.s, r.i): (r.samples_seen, r.unique_seen) for r in stats.seen_so_far(["s"], ["i"], "item", df).collect()}
    steps = {(r.s, r.step): (r.mean, r.n) for r in stats.tumbling_mean(df, ["s"], ["i"], "x", 8).collect()}
    ends = {r.s: (r.first_mean, r.last_mean) for r in stats.end_means(df, ["s"], ["i"], "x", 20).collect()}
    for s in ("long", "short", None):
        own = [r for r in rows if r[0] == s]
        values = [r[3] for r in own]
        for k, r in enumerate(own):
            want = None if k < 6 else pytest.approx(sum(values[k - 6 : k + 1]) / 7)
            assert trailing[s, r[1]] == want
            assert seen[s, r[1]] == (k + 1, len({x[2] for x in own[: k + 1]}))
        for k in range(0, len(own), 8):
            assert steps[s, k // 8 + 1] == (pytest.approx(sum(values[k : k + 8]) / len(values[k : k + 8])), len(values[k : k + 8]))
        assert ends[s] == ((None, None) if len(own) < 20 else (pytest.approx(sum(values[:20]) / 20), pytest.approx(sum(values[-20:]) / 20)))
    assert stats.trailing_mean(df.limit(0), ["s"], ["i"], "x", "t").count() == 0


def test_numbering_and_digests_of_sparse_places(spark):
    from docgauge.operators.digests import sequence_digest
    from docgauge.operators.numbering import numbered

    df = spark.createDataFrame([(i % 3 or None, i * 10**9 - 7, f"v{i}") for i in range(500)], "g long, at long, v string").repartition(6)
    found = defaultdict(list)
    for r in numbered(df, ["g"], ["at"]).collect():
        found[r.g].append((r.at, r["__place"]))
    assert all([p for _, p in sorted(x)] == list(range(len(x))) for x in found.values()) and len(found) == 3
    near = df.withColumn("at", F.expr("(at + 7) div 1000000000"))
    assert {tuple(r) for r in sequence_digest(df, ["g"], F.col("v"), F.col("at")).collect()} == {tuple(r) for r in sequence_digest(near, ["g"], F.col("v"), F.col("at")).collect()}


def test_picks_fills_and_cuts(spark):
    from docgauge.operators.sampling import cut_rows, fill_categories, size_picks

    rows = spark.createDataFrame([("r", i, i % 4 == 3, i % 5 == 0, i > 6) for i in range(1, 12)] + [("s", 1, False, False, False)], "run string, q long, lost boolean, same boolean, moved boolean")
    got = fill_categories(rows, "run", "q", {"lost": F.col("lost")}, {"same": F.col("same")}, {"moved": F.col("moved")}, 4, 1).collect()
    mine = sorted((r.place, r.q, r.category) for r in got if r.run == "r")
    assert [c for _, _, c in mine] == ["lost", "same", "moved", "moved"] and mine[0][1] == 3 and len({q for _, q, _ in mine}) == 4
    assert [(r.q, r.category) for r in got if r.run == "s"] == [(1, "fill")]
    sized = spark.createDataFrame([("a", i, i * i) for i in range(7)] + [("b", 50, 1)], "s string, d long, n long")
    picks = {(r.s, r.d): r.pick for r in size_picks(sized, "s", "d", "n", spark.createDataFrame([("a", 6), ("b", 50)], "s string, d long")).collect()}
    assert picks == {("a", 3): 1, ("a", 6): 2, ("b", 50): 1}
    kept = cut_rows(rows.where("run = 'r'"), ["q"], 5, 2, F.col("lost")).orderBy("place").collect()
    assert [r.q for r in kept] == [1, 2, 4, 5, 6]


def test_percentiles_against_numpy(spark):
    import numpy as np

    from docgauge.operators.stats import percentiles_linear, percentiles_nearest

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.gauss(0, 1), rng.expovariate(0.01), float(rng.randrange(5)), -0.0])) for _ in range(900)] + [("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    ps = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    linear = {r.g: r for r in percentiles_linear(df, ["g"], "x", ps).collect()}
    nearest = {r.g: r for r in percentiles_nearest(df, ["g"], "x", ps).collect()}
    for g in ("a", "b", None, "one"):
        values = np.sort([x for k, x in rows if k == g and x is not None and x == x])
        for name, p in ps.items():
            assert linear[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
            assert nearest[g][name] == values[int(np.rint(p * (len(values) - 1)))]
    assert percentiles_linear(df.limit(0), ["g"], "x", ps).count() == 0


def test_bootstrap_query_draws_as_often_as_the_published_run(spark, data):
    assert resampling.bootstrap_interval(spark, data).first().replicates == 2000


def test_comparisons_cover_every_system(spark, data):
    log = spark.read.parquet(f"{data}/holdout_predictions.parquet").where("NOT is_warmup")
    systems = {r.system for r in log.select("system").distinct().collect()}
    assert len(systems) > 3
    for query in (comparison.delta_to_base_all, comparison.gallery_picks_all):
        assert {r.system for r in query(spark, data).select("system").collect()} == systems
    assert {c[5:] for c in comparison.wide_predictions_all(spark, data).columns if c.startswith("pred_")} == systems


def test_exact_sum_of_odd_values(spark):
    rows = [("halves", x) for x in [0.1] * 10] + [("null", None), ("both", 0.5), ("both", None), ("both", 2e6), ("nan", float("nan")), ("nan", 1.0), ("inf", float("-inf")), ("inf", 1.0), ("zero", 0.0)]
    found = {r.k: r.s for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert math.isnan(found.pop("nan"))
    assert found == {"halves": 1.0, "null": None, "both": 2000000.5, "inf": float("-inf"), "zero": 0.0}


def test_paired_means_halfway_do_not_depend_on_the_order(spark, tmp_path):
    """Means of 2000 questions that lie halfway between two numbers of six digits."""
    draw, rows, sums = random.Random(7), [], {}
    for run in range(12):
        base, other = ([round(draw.random(), 4) for _ in range(400)] for _ in range(2))
        units = sum(round(b * 10000) - round(a * 10000) for a, b in zip(base, other))
        spare = (10 - units) % 20 / 10000
        i = next(i for i, x in enumerate(other) if x < 0.9)
        other[i] = round(other[i] + spare, 4)
        sums[f"run_{run}"] = math.fsum(b - a for a, b in zip(base, other))
        rows += [(f"run_{run}", s, q, "ok", "x", (x, 0.0), 1, q, False) for s, xs in ((comparison.BASE, base), (comparison.OTHER, other)) for q, x in enumerate(xs)]
    kind = "run_tag string, system string, question_id long, status string, prediction string, metrics struct<anls_normalized_strict_v2:double,exact_match:double>, logged_at long, record_id long, is_warmup boolean"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/holdout_predictions.parquet")
    spark.range(2000).withColumnRenamed("id", "question_id").write.parquet(f"{tmp_path}/manifest_examples.parquet")
    expected = {k: float(Decimal(repr(x / 2000)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for k, x in sums.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 5):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.run_tag: r.mean_delta for r in evidence.paired_required(spark, str(tmp_path)).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
