from pyspark.sql import functions as F

from docgauge.functions.validation import refusal_reason


def test_first_reason(spark):
    rows = [("q", 4, 10, 10, 10), (" ", 4, 10, 10, 10), (None, 4, 10, 10, 10), ("q" * 4001, 4, 10, 10, 10), ("q", 5, 10, 10, 10), ("q", 4, 13 << 20, 10, 10), ("q", 4, 10, 8000, 8000), ("q", None, 1, 1, 1), ("q", 1, 1, None, 1), ("q" + " " * 4100, 4, 10, 10, 10), ("q", 4, 0, 10, 10), ("q", 4, -1, 10, 10), ("q", 4, None, 10, 10)]
    df = spark.createDataFrame(rows, "q string, c int, s long, w int, h int")
    found = [r[0] for r in df.select(refusal_reason(*[F.col(c) for c in "qcswh"])).collect()]
    assert found == [None, "blank_question", "blank_question", "long_question", "tile_cap", "file_size", "pixels", "tile_cap", "pixels", None, "file_size", "file_size", "file_size"]
