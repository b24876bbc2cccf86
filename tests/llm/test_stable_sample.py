import random

from pyspark.sql import functions as F

from docgauge.llm.stable_sample import stable_sample
from docgauge.llm.stable_sample_queries import SQL, p3_sample
from tests.oracle import assert_same, connect


def ids(df):
    return {r.q for r in df.collect()}


def test_same_for_any_order_and_growth(spark):
    numbers = list(range(-50, 3000)) + [2**62, -(2**63), 2**63 - 1, 7, 7, None, None]
    random.Random(1).shuffle(numbers)
    df = spark.createDataFrame([(n, "x") for n in numbers], "q long, extra string")
    first = ids(stable_sample(df, "q", 0.2))
    assert first == ids(stable_sample(df.orderBy("q").repartition(7), "q", 0.2))
    early = df.where("q < 1000")
    assert ids(stable_sample(early, "q", 0.2)) == {n for n in first if n < 1000}
    assert ids(stable_sample(df, "q", 0.1)) <= first
    assert None not in first


def test_even_coverage(spark):
    for start, step in ((0, 1), (10**12, 1), (5, 97)):
        df = spark.range(2000).select((F.col("id") * step + start).alias("q"))
        assert abs(len(ids(stable_sample(df, "q", 0.1))) - 200) <= 6


def test_bounds_and_empty(spark):
    df = spark.range(50).select(F.col("id").alias("q"))
    assert stable_sample(df, "q", 0.0).count() == 0 and stable_sample(df, "q", 1.0).count() == 50
    assert stable_sample(df.limit(0), "q", 0.5).count() == 0


def test_equals_sql(spark, data):
    assert_same(p3_sample(spark, data), connect(data), SQL["p3_sample"])


def test_even_coverage_of_the_records_themselves(spark, data):
    """Real ids have gaps, so the sample is as even as one drawn by chance, or better; each batch adds to it."""
    sent = spark.read.parquet(f"{data}/internvl_error_sample_v1.parquet").select("question_id", "batch_id")
    n = sent.select("question_id").distinct().count()
    for share in (0.1, 0.5):
        size = stable_sample(sent, "question_id", share).count()
        assert abs(size - share * n) <= 3 * (n * share * (1 - share)) ** 0.5
    early = sent.where(F.col("batch_id") <= sent.agg(F.min("batch_id")).first()[0])
    assert {r.question_id for r in stable_sample(early, "question_id", 0.1).collect()} <= {r.question_id for r in stable_sample(sent, "question_id", 0.1).collect()}
