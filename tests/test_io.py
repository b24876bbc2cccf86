import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge import schema
from docgauge.plans import flows
from docgauge.sinks import reports
from docgauge.sources import documents, images, jsonl
from docgauge.streaming import scores

LINE = "question_id long, status string, prediction string, run_fingerprint struct<run_fingerprint_sha256:string>"


def write_lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_jsonl_order_and_modes(spark, tmp_path):
    rows = [{"question_id": i % 40, "status": "ok", "prediction": f"p{i}", "run_fingerprint": {"run_fingerprint_sha256": "f" if i % 2 else "g"}} for i in range(400)]
    path = write_lines(tmp_path / "log.jsonl", [*rows[:200], "", *rows[200:]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    last = {r.question_id: r.prediction for r in jsonl.read_last(spark, path, LINE, "question_id").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert last == {i: f"p{360 + i}" for i in range(40)}
    first = jsonl.first_match(jsonl.read_jsonl(spark, path, LINE), F.col("question_id") == 3).first()
    assert first.prediction == "p3"
    same, other = jsonl.read_compatible(spark, path, LINE, "f")
    assert (same.count(), other.count()) == (200, 200)
    bad = write_lines(tmp_path / "bad.jsonl", [rows[0], "{not json"])
    assert jsonl.read_jsonl(spark, bad, LINE, tolerant=True).count() == 1
    with pytest.raises(Exception, match="bad JSON line"):
        jsonl.read_jsonl(spark, bad, LINE).collect()
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), LINE).count() == 0
    required = spark.createDataFrame([(1,)], "question_id long")
    with pytest.raises(ValueError, match="duplicate"):
        jsonl.read_once(spark, path, LINE, "question_id", required)
    with pytest.raises(ValueError, match="unexpected"):
        jsonl.read_once(spark, write_lines(tmp_path / "one.jsonl", rows[:1]), LINE, "question_id", required)


@pytest.mark.parametrize("shape", [lambda r: {"answers": r}, lambda r: {"records": r}, lambda r: r])
def test_sidecar_shapes(spark, tmp_path, shape):
    path = tmp_path / "answers.json"
    path.write_text(json.dumps(shape([{"question_id": 1, "answers": ["a"]}])))
    assert [tuple(r)[:2] for r in documents.read_answers(spark, str(path)).collect()] == [(1, ["a"])]


def test_sidecar_of_another_shape_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text('"text"')
    with pytest.raises(Exception, match="neither"):
        documents.read_answers(spark, str(tmp_path / "x.json")).collect()


def test_rescore_end_to_end(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "m", "examples": [{"index": i, "question_id": i} for i in (1, 2, 3)]}, indent=1))
    (tmp_path / "a.json").write_text(json.dumps({"answers": [{"question_id": i, "answers": [f"answer {i}"]} for i in (1, 2, 3)]}))
    log = write_lines(tmp_path / "p.jsonl", [{"question_id": 1, "status": "ok", "prediction": "wrong"}, {"question_id": 1, "status": "ok", "prediction": "Answer 1"}, {"question_id": 2, "status": "error", "prediction": None, "metrics": {"anls": 0.9}}])
    out = tmp_path / "out"
    out.mkdir()
    r = flows.rescore(spark, str(tmp_path / "m.json"), str(tmp_path / "a.json"), log, str(out)).first()
    assert (r.n_requested, r.n_ok, r.n_failed, r.n_missing) == (3, 1, 1, 1)
    assert r.mean_score == pytest.approx(1 / 3)
    assert json.loads((out / "summary.json").read_text())[0]["n_ok"] == 1
    with pytest.raises(FileExistsError, match="summary.json"):
        flows.rescore(spark, str(tmp_path / "m.json"), str(tmp_path / "a.json"), log, str(out))


def test_predictions_resume(spark, tmp_path):
    examples = spark.createDataFrame([(1, "a"), (2, "fail"), (3, "c")], "question_id long, question string")
    store = str(tmp_path / "store")

    def make():
        def predictor(question):
            if question == "fail":
                raise RuntimeError("no")
            return question.upper()

        return predictor

    for _ in range(2):
        flows.resume_run(examples, store, make, "f1")
    rows = reports.stored(spark, store, spark.read.parquet(store).drop("__folder").schema)
    assert rows.where("status = 'ok'").count() == 2 and rows.where("status = 'error'").count() == 1
    with pytest.raises(ValueError, match="fingerprint"):
        flows.resume_run(examples, store, make, "f2")
    state, _ = flows.cache_state({"step": 1}, rows, {"step": 1}, n_requested=3)
    assert state == "ok_complete"
    assert flows.cache_state({"step": 1}, rows, {"step": 2}, n_requested=3)[0] == "incompatible"
    assert flows.cache_state(None, None, {}, n_requested=3)[0] == "missing"


def test_train_subset(spark, tmp_path):
    rows = [(i, i % 20, f"doc{i % 10}", str(i % 3), f"q{i}", [None, " ", f"a{i}"] if i % 7 else [], None, bytes([i % 250])) for i in range(100)]
    source = str(tmp_path / "source")
    spark.createDataFrame(rows, "question_id long, doc_id long, ucsf_document_id string, ucsf_document_page_no string, question string, answers array<string>, target_answer string, image binary").write.parquet(source)
    blocked = {"question": spark.createDataFrame([(1,)], "q long"), "ucsf": spark.createDataFrame([("doc3",)], "d string"), "image": spark.createDataFrame([(bytes([2]),)], "b binary").select(F.sha2("b", 256).alias("h"))}
    kept, reasons = flows.build_train_subset(spark, source, blocked, target_rows=30)
    got = kept.collect()
    assert len(got) == 30 and all(r.ucsf != "doc3" and r.question_id not in (1, 2) and r.question_id % 7 for r in got)
    assert {r.reason for r in reasons.collect()} >= {"no_valid_answer", "question", "ucsf"}
    assert flows.audit_splits({"a": kept, "b": kept.limit(0)}, {"q": "question_id"}).where("shared > 0").isEmpty()


def test_compare_runs(spark):
    required = spark.createDataFrame([(1,), (2,)], "question_id long")
    base = spark.createDataFrame([(1, 0.0), (2, 1.0)], "question_id long, score double")
    groups = spark.createDataFrame([(1, "g"), (2, "h")], "question_id long, group string")
    first = flows.compare_runs(required, base, base, groups)
    interval = {k: first[k] for k in ("scores_digest", "groups_digest")} | {"low": 0.0}
    assert first["tied"] == 2 and first["interval"] is None
    assert flows.compare_runs(required, base, base, groups, interval)["interval"]["low"] == 0.0
    other = base.withColumn("score", 1 - F.col("score"))  # same mean, other pairs
    assert flows.compare_runs(required, base, other, groups, interval)["interval"] is None


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a|b"), (2, None, None)], "x long, y double, t string")
    reports.write_report(df, tmp_path / "r.json")
    reports.write_markdown(df, tmp_path / "r.md", "Title")
    reports.write_line_chart(df, "x", "y", tmp_path / "r.svg")
    assert json.loads((tmp_path / "r.json").read_text())[0]["y"] == 0.5
    assert r"a\|b" in (tmp_path / "r.md").read_text() and "polyline" in (tmp_path / "r.svg").read_text()
    for draw in (lambda d, to: reports.write_bar_chart(d, "t", ["x", "y"], to), lambda d, to: reports.write_scatter(d, "x", "y", to)):
        for rows in (df, df.limit(0)):
            draw(rows, tmp_path / "c.svg")
            assert (tmp_path / "c.svg").read_text().startswith("<svg")
    assert reports.figures({"good": lambda: None, "bad": lambda: 1 / 0}) == {"good": None, "bad": "ZeroDivisionError: division by zero"}
    listed = spark.createDataFrame([("a", "included", 5), ("b", "missing", 0), ("c", "included", 2)], "path string, status string, length long")
    assert tuple(reports.packet_totals(listed).first()) == (2, 1, 0, 0, 7)
    with pytest.raises(ValueError, match="outside"):
        reports.confined(tmp_path / ".." / "x", tmp_path)
    (tmp_path / "a.txt").write_text("x")
    files = documents.file_digests(spark, str(tmp_path / "*.txt"))
    listed = spark.createDataFrame([(files.first().path,), ("file:/none.txt",), ("file:/x.png",)], "path string")
    inventory = {r.path.rsplit("/", 1)[-1]: r.status for r in reports.review_inventory(files, listed).collect()}
    assert inventory == {"a.txt": "included", "none.txt": "missing", "x.png": "missing"}


@pytest.fixture
def shared(spark, tmp_path):
    """A folder behind a scheme that is not the local one."""
    spark.conf.set("fs.viewfs.mounttable.shared.link./data", f"file:{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shared.link./data", f"file:{tmp_path}")
    yield "viewfs://shared/data"
    spark.conf.unset("fs.viewfs.mounttable.shared.link./data")


def test_guards_see_shared_file_systems(spark, tmp_path, shared):
    for root in (shared, f"file:{tmp_path}"):
        (tmp_path / "there.json").write_text("{}")
        with pytest.raises(FileExistsError, match="there.json"):
            reports.refuse_overwrite(spark, [f"{root}/there.json", f"{root}/free.json"])
        reports.refuse_overwrite(spark, [f"{root}/there.json"], overwrite=True)
        reports.refuse_overwrite(spark, [f"{root}/free.json"])
        store = f"{root}/store-{root[:4]}"
        examples = spark.createDataFrame([(1, "a")], "question_id long, question string")
        flows.resume_run(examples, store, lambda: str.upper, "f1")
        with pytest.raises(ValueError, match="fingerprint"):
            flows.resume_run(examples, store, lambda: str.upper, "f2")
        reports.write_report(examples, f"{root}/report.json")
        assert json.loads((tmp_path / "report.json").read_text())[0]["question"] == "a"


def test_a_store_keeps_the_same_row_at_every_replay(spark, tmp_path):
    kind = "k long, at long, text string"
    rows = [(i % 50, i, f"t{i}") for i in range(200)] + [(None, 5, "x"), (None, 4, "y")]
    kept = []
    for name in "ab":
        store = str(tmp_path / name)
        for part in (rows[:90], rows[60:], rows):
            reports.append_records(spark.createDataFrame(part, kind).repartition(5), store, ["k"], order=["at"])
        kept.append(sorted(map(tuple, reports.stored(spark, store, kind).collect()), key=str))
    assert kept[0] == kept[1] and len(kept[0]) == 51 and (3, 3, "t3") in kept[0] and (None, 4, "y") in kept[0]
    assert reports.stored(spark, str(tmp_path / "none"), kind).count() == 0


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from docgauge import session

    def fake(master):
        context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            session.shared_checkpoint_dir(fake(master))


def test_images(spark):
    pixels = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    data = images.encode_png(pixels)
    assert (images.decode_png(data) == pixels).all()
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"junk"),), (None,)], "b binary")
    assert [r[0] for r in df.select(images.rgb_digest(F.col("b"))).collect()] == [images.pixel_digest(pixels), None, None]
    assert (images.white_like(pixels) == 255).all()


def test_resizing():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (9, 14, 3), dtype=np.uint8)
    assert (images.resized(pixels, 14, 9) == pixels).all()
    for width, height in ((28, 18), (7, 4), (5, 20), (1, 1)):
        out = images.resized(pixels, width, height)
        assert out.shape == (height, width, 3)
        assert (images.resized(np.full_like(pixels, 77), width, height) == 77).all()

    def slow(row, new):  # one row of one channel, in floats
        scale = len(row) / new
        wide = max(1.0, scale)
        made = []
        for i in range(new):
            c = (i + 0.5) * scale
            low, high = max(0, int(c - 2 * wide + 0.5)), min(len(row), int(c + 2 * wide + 0.5))
            t = [abs((x - c + 0.5) / wide) for x in range(low, high)]
            w = [1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0 for d in t]
            made.append(min(255, max(0, sum(a * b for a, b in zip(w, row[low:high])) / sum(w))))
        return made

    for new in (7, 5, 31):
        assert np.abs(images.resized(pixels, new, 9)[3, :, 1] - np.array(slow(pixels[3, :, 1].astype(float), new))).max() <= 0.51
    assert images.half_detail(pixels).shape == pixels.shape and (images.half_detail(pixels) != pixels).any()
    data, meta = images.perturbed(images.encode_png(pixels), "half_detail")
    assert (images.decode_png(data) == images.half_detail(pixels)).all() and meta["original_size"] == meta["pre_model_size"] == [14, 9]
    assert images.perturbed(images.encode_png(pixels), "clean")[1]["source_rgb_png_sha256"] == images.perturbed(images.encode_png(pixels), "clean")[1]["transformed_rgb_png_sha256"]
    with pytest.raises(ValueError, match="unknown"):
        images.perturbed(images.encode_png(pixels), "jpeg_q40")


def test_tiles_and_materialised_images(spark, tmp_path):
    from docgauge.functions.geometry import tile_count

    sizes = [(32, 8), (8, 8), (20, 15)]
    made = [np.arange(w * h * 3, dtype=np.uint64).astype(np.uint8).reshape(h, w, 3) for w, h in sizes]
    rows = [(i, bytearray(images.encode_png(x))) for i, x in enumerate(made)] + [(8, bytearray(b"junk")), (9, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    found = images.image_tiles(df, "id", "content", 12, 8).collect()
    want = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "id long, w int, h int").select("id", tile_count(F.col("w"), F.col("h"), 12, 8).alias("n"))
    assert {r.id: r.n for r in want.collect()} == {i: sum(r.id == i for r in found) for i in range(3)}
    first = next(r for r in found if r.id == 0 and r.tile == 0)
    assert images.decode_png(bytes(first.png)).shape == (8, 8, 3) and images.pixel_digest(images.decode_png(bytes(first.png))) == first.rgb_digest
    assert (images.decode_png(bytes(first.png)) == made[0][:, :8]).all()
    store = str(tmp_path / "images")
    for part in (df.where("id < 1"), df, df.withColumn("content", F.lit(bytearray(images.encode_png(made[1]))))):
        images.materialise(part, "id", "content", store)
    kept = reports.stored(spark, store, "id long, rgb_digest string, png_sha256 string, png binary").collect()
    assert sorted((r.id, r.rgb_digest) for r in kept) == sorted({(i, images.pixel_digest(x)) for i, x in enumerate(made)} | {(i, images.pixel_digest(made[1])) for i in (0, 1, 2, 8, 9)})


def test_files_that_must_be_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    files = documents.file_digests(spark, str(tmp_path / "*.txt"))
    listed = files.select("path")
    assert documents.missing_files(listed, files).count() == 1
    with pytest.raises(ValueError, match="missing"):
        documents.missing_files(listed.unionByName(spark.createDataFrame([("file:/none",)], "path string")), files)
    assert documents.list_files(spark, str(tmp_path), suffix=".txt").first().name == "a.txt"
    with pytest.raises(FileNotFoundError):
        documents.list_files(spark, str(tmp_path), suffix=".png")
    with pytest.raises(KeyError):
        spark.range(3).write.parquet(str(tmp_path / "t"))
        documents.point_lookup(spark, str(tmp_path / "t"), "id", 7, [])


def test_stream_adds_nothing_twice(spark, tmp_path):
    kind = "question_id long, score double"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0)], kind).write.parquet(source)
    for checkpoint in ("a", "b"):  # the second run replays everything
        query = scores.stream_once(spark, source, kind, store, str(tmp_path / checkpoint), ["question_id"], lambda df: df.withColumn("score", F.col("score") * 2))
        query.awaitTermination(120)
    assert sorted(map(tuple, reports.stored(spark, store, kind).collect())) == [(1, 1.0), (2, 2.0)]


def test_schemas_parse(spark):
    for ddl in (schema.MANIFEST, schema.ANSWERS, schema.PREDICTION, schema.TRAINING_LOG, schema.ANSWER_ROW):
        assert spark.createDataFrame([], ddl).count() == 0
