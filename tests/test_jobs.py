import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.functions.scoring import stored_metric
from docgauge.functions.text import error_tags
from docgauge.operators.compare import same_rows
from docgauge.plans import jobs
from docgauge.sources import images


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seed": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.yaml").write_text("seed: 1\n")
    assert jobs.read_settings(spark, str(tmp_path / "a.json")) == {"seed": 1}
    with pytest.raises(ValueError, match="no settings"):
        jobs.read_settings(spark, str(tmp_path / "b.json"))
    try:
        import yaml  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(ValueError, match="YAML"):
            jobs.read_settings(spark, str(tmp_path / "c.yaml"))
    else:
        assert jobs.read_settings(spark, str(tmp_path / "c.yaml")) == {"seed": 1}
    rules = {"root": "artifacts/p3", "outputs": ["log"], "forbidden": ["checkpoints/v1"]}
    assert jobs.derived_settings({"seed": 1}, {"seed": 2, "log": "artifacts/p3/x"}, **rules)["seed"] == 2
    for log in ("elsewhere/x", "artifacts/p3/../x", "artifacts/p33/x"):
        with pytest.raises(ValueError, match="outside"):
            jobs.derived_settings({}, {"log": log}, **rules)
    with pytest.raises(ValueError, match="checkpoints/v1"):
        jobs.derived_settings({"deep": [{"from": "checkpoints/v1/x"}]}, {"log": "artifacts/p3/x"}, **rules)
    makers = {"default": lambda s: str.upper, "tiles": lambda s: lambda q: f"{q}{s['cap']}"}
    assert jobs.predictor_of({}, makers)()("a") == "A" and jobs.predictor_of({"adapter": "tiles", "cap": 4}, makers)()("a") == "a4"
    with pytest.raises(ValueError, match="unknown"):
        jobs.predictor_of({"adapter": "x"}, makers)


def test_only_missing_runs_are_made(spark, tmp_path):
    done, made, told = str(tmp_path / "done.json"), [], []
    states = {"a": ("ok_complete", []), "b": ("missing", ["none"])}
    for now, want in ((states, ["b"]), ({"a": states["a"], "b": states["a"]}, []), (states, ["b"])):
        assert jobs.run_missing(spark, now, made.append, lambda: told.append(1), done) == want
    assert made == ["b", "b"] and told == [1, 1] and json.loads((tmp_path / "done.json").read_text()) == {"made": ["b"]}
    with pytest.raises(ValueError, match="incompatible"):
        jobs.run_missing(spark, {"a": ("incompatible", ["step"]), "b": ("missing", [])}, made.append, lambda: None, done)
    assert made == ["b", "b"]


def test_training_report(spark, tmp_path):
    lines = [{"update": i, "loss": 1 / i, "samples_seen": 8 * i, "unique_examples_seen": min(50, 8 * i), "peak_allocated_bytes": 10 * i} for i in range(1, 46)]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    r = jobs.training_report(spark, str(tmp_path / "log.jsonl")).first()
    assert (r.updates, r.contiguous, r.samples_seen, r.unique_examples_seen, r.peak_allocated_bytes) == (45, True, 360, 50, 450)
    assert r.first_mean == pytest.approx(sum(1 / i for i in range(1, 21)) / 20) and r.last_mean == pytest.approx(sum(1 / i for i in range(26, 46)) / 20)
    (tmp_path / "gap.jsonl").write_text("\n".join(map(json.dumps, lines[:3] + lines[5:9])))
    r = jobs.training_report(spark, str(tmp_path / "gap.jsonl")).first()
    assert not r.contiguous and r.first_mean is None


def test_stored_scores_of_any_layout(spark):
    new = spark.createDataFrame([((0.0, None), 0.7), ((None, None), 0.7), (None, None)], "metrics struct<anls_v2:double, em:double>, anls double")
    old = spark.createDataFrame([((0.4,),), (None,)], "scores struct<anls:double>")
    assert [r[0] for r in new.select(stored_metric(new, ["anls_v2", "anls"])).collect()] == [0.0, 0.7, 0.0]
    assert [r[0] for r in old.select(stored_metric(old, ["anls_v2", "anls"], default=None)).collect()] == [0.4, None]
    assert spark.range(1).select(stored_metric(spark.range(1), ["anls"])).first()[0] == 0.0


def test_tags_and_rows_that_agree(spark):
    df = spark.createDataFrame([("ab c", ["a bc"], True), ("red", ["red blue"], False), ("green", ["red"], None)], "p string, r array<string>, o boolean")
    assert [r[0][:2] for r in df.select(error_tags(F.col("p"), F.col("r"), F.col("o"))).collect()] == [
        ["formatting_difference", "image_opened_no_ocr_layout_tooling"], ["possible_partial_span_or_entity_uncertain", "image_not_inspected"], ["content_mismatch_string_level", "image_not_inspected"],
    ]
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    same_rows(a, a, "k", ["v"])
    with pytest.raises(ValueError, match="differ"):
        same_rows(a, a.withColumn("v", F.lit("x")), "k", ["v"])


def test_image_audit(spark):
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    png, other = images.encode_png(pixels), images.encode_png(pixels[::-1])
    rgb = images.pixel_digest(pixels)
    digest = images.hashlib.sha256(png).hexdigest()
    files = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(b"junk")), ("c", bytearray(other)), ("d", bytearray(png)), ("e", bytearray(png))], "path string, content binary")
    rows = spark.createDataFrame([("a", digest, rgb), ("b", digest, rgb), ("c", digest, rgb), ("d", "0" * 64, rgb), ("e", None, None), ("f", digest, rgb)], "p string, png string, rgb string")
    states = {r.p: r.image_state for r in images.audited_images(rows, files, "p", "png", "rgb").collect()}
    assert states == {"a": "ok", "b": "corrupt", "c": "mismatch", "d": "repaired_ok", "e": "ok", "f": "missing"}
    assert [r[0] and tuple(r[0]) for r in files.orderBy("path").select(images.png_size(F.col("content"))).collect()] == [(4, 2), None, (4, 2), (4, 2), (4, 2)]
