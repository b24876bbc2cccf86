import pytest
from pyspark.sql import functions as F

from docgauge.functions import geometry, sequences, text
from docgauge.functions.scoring import metrics

ANSWERS = "prediction string, refs array<string>, status string"


def one(spark, prediction, refs, status="ok", column=None):
    df = spark.createDataFrame([(prediction, refs, status)], ANSWERS)
    return df.select((column if column is not None else metrics(F.col("prediction"), F.col("refs"), F.col("status"))).alias("x")).first()["x"]


def test_normalize_follows_unicode_white_space(spark):
    df = spark.createDataFrame([("  Foo   BAR\n",), ("a b",), ("a\x1cb\x85c",), ("a​b",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()] == ["foo bar", "a b", "a b c", "a​b", None]


@pytest.mark.parametrize(
    ("prediction", "refs", "strict", "inclusive", "exact"),
    [
        ("HELLO", ["hello"], 1.0, 1.0, 1.0),
        ("hello   world", ["hello world"], 1.0, 1.0, 1.0),
        ("a" * 10, ["aaaaabbbbb"], 0.0, 0.5, 0.0),
        ("a" * 10, ["aaaaaabbbb"], 0.6, 0.6, 0.0),
        ("a" * 10, ["aaaabbbbbb"], 0.0, 0.0, 0.0),
        ("nnk", ["zzzz", "NNK"], 1.0, 1.0, 1.0),
        ("", ["hello"], 0.0, 0.0, 0.0),
        ("x", ["", "  "], 0.0, 0.0, 0.0),
        ("x", None, 0.0, 0.0, 0.0),
        ("çé", ["ce"], 0.0, 0.0, 0.0),
        ("garçon", ["garcon"], 5 / 6, 5 / 6, 0.0),
    ],
)
def test_scores(spark, prediction, refs, strict, inclusive, exact):
    m = one(spark, prediction, refs)
    assert (m.strict, m.inclusive, m.exact_match) == pytest.approx((strict, inclusive, exact))


def test_punctuation_counts_and_failures_score_nothing(spark):
    assert one(spark, "83.4 %.", ["83.4%"]).strict > 0.5
    assert one(spark, "83.4 %.", ["83.4%"]).exact_match == 0
    failed = one(spark, None, ["a"], "error")
    assert (failed.strict, failed.exact_match, failed.failure, failed.scored) == (0.0, 0.0, True, False)
    assert one(spark, "a", ["a"], "error").primary == 0.0
    assert one(spark, "x", ["", " "]).invalid_references


def test_raw_length_uses_upper_case_lengths(spark):
    assert one(spark, "straße", ["strasse"]).raw_length == pytest.approx(1 - 2 / 7)


def test_period_variants_and_tags(spark):
    p, r = F.col("prediction"), F.col("refs")
    assert one(spark, "Yes.", ["yes"], column=text.exact_without_period(p, r)) == 1.0
    assert one(spark, "Yes..", ["yes"], column=text.exact_without_period(p, r)) == 0.0
    assert one(spark, "", ["", "a"], column=text.exact_without_period(p, r)) == 0.0
    assert one(spark, "", ["", "a"], column=text.exact_without_period(p, r, keep_blank=True)) == 1.0
    assert one(spark, "ab c", ["a bc"], column=text.error_tag(p, r)) == "formatting"
    assert one(spark, "red", ["red blue"], column=text.error_tag(p, r)) == "partial"
    assert one(spark, "green", ["red blue"], column=text.error_tag(p, r)) == "content"
    assert one(spark, ' {"a": 1} ', [], column=text.json_document(p, "a int", ["a"])).a == 1
    assert one(spark, '{"a": 1} tail', [], column=text.json_document(p, "a int", ["a"])) is None


def test_token_ends(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 50, 51, 99, 7, 99], 4, 99), ([1, 2, 3, 4, 5], 3, 77), ([1, 2, 3], 3, 9)], "ids array<int>, p int, e int")
    ids, p, e = F.col("ids"), F.col("p"), F.col("e")
    assert [r[0] for r in df.select(sequences.terminated(ids, p, e)).collect()] == [[1, 2, 3, 4, 50, 51, 99], [1, 2, 3, 4, 5, 77], None]
    assert [r[0] for r in df.select(sequences.termination_fault(ids, p, e)).collect()] == ["several ends", "no end", "empty"]
    masks = spark.createDataFrame([([-100, -100, 5, -100],)], "l array<int>")
    assert masks.select(sequences.mask_runs(F.col("l"))).first()[0] == "[MASK×2] 5 [MASK×1]"


def test_geometry(spark):
    assert geometry.candidate_caps(12) == [12, 4, 1]
    df = spark.createDataFrame([(1600, 400), (448, 448), (100, 100), (4000, 3000)], "w int, h int")
    tiles = [r[0] for r in df.select(geometry.tile_count(F.col("w"), F.col("h"), 12)).collect()]
    assert tiles == [5, 1, 1, 13]
    box = df.select(geometry.thumbnail_box(F.col("w"), F.col("h"), 200, 200)).collect()
    assert tuple(box[0][0]) == (200, 50)
    assert tuple(box[2][0]) == (100, 100)
