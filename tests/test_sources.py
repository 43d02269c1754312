"""File sources and sinks on generated files."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from boxspark.operators import pixels
from boxspark.sources import annotations as an
from boxspark.sources import labels as lb
from boxspark.streaming.label_stream import class_counts, stream_label_lines


def _png(path, rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_labels_round_trip(spark, tmp_path):
    folder = tmp_path / "labels" / "train"
    folder.mkdir(parents=True)
    (folder / "street.txt").write_text("3 0.25 0.75 0.125 0.5\n7 0.1\n\n2 0.4 0.4 wide 0.1\nsee notes\n1.5 0.2 0.2 0.1 0.1\n1 0.875 0.5 0.25 0.0625 0.35\n")
    (folder / "my_classes.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    (folder / "nothing.txt").write_text("")
    rows, rejects = lb.parse_label_lines(lb.read_label_lines(spark, str(tmp_path / "labels")))
    got = sorted((r.image_id, r.split, r.box_idx, r.class_id, r.w, r.conf) for r in rows.collect())
    assert got == [("street", "train", 0, 3, 0.125, 1.0), ("street", "train", 6, 1, 0.25, 0.35)]
    assert sorted(r._reason for r in rejects.collect()) == ["not a number", "not a number", "too few fields", "too few fields"]
    text = lb.label_text(rows, with_conf=True).first().text
    assert text == "3 0.250000 0.750000 0.125000 0.500000 1.0000\n1 0.875000 0.500000 0.250000 0.062500 0.3500"
    kept = lambda df: sorted((r.image_id, r.split, r.class_id, r.cx, r.cy, r.w, r.h, r.conf) for r in df.collect())
    lb.write_label_files(rows, str(tmp_path / "files"), with_conf=True)
    assert sorted(p.name for p in (tmp_path / "files").rglob("*") if p.is_file()) == ["street.txt"]
    lb.write_label_table(rows, str(tmp_path / "table"), with_conf=True)
    for lines in (lb.read_label_lines(spark, str(tmp_path / "files")), lb.read_label_table(spark, str(tmp_path / "table"))):
        again, bad = lb.parse_label_lines(lines)
        assert kept(again) == kept(rows) and bad.count() == 0
    images = spark.createDataFrame([("street", "train"), ("nothing", "train")], "image_id string, split string")
    assert sorted((r.image_id, r.class_id) for r in an.associate(images, rows).collect() if r.class_id != 1) == [("nothing", None), ("street", 3)]


def test_coco_and_voc(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}], "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "bbox": [10, 10, 20, 10]}], "categories": [{"id": 3, "name": "x"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, found, categories = an.read_coco(spark, str(tmp_path / "c.json"))
    from boxspark.operators.convert import coco_labels

    row = coco_labels(found, images).first()
    assert (row.class_id, row.cx, row.cy, row.w, row.h) == (2, 0.2, 0.3, 0.2, 0.2) and categories.count() == 1
    voc = tmp_path / "voc"
    voc.mkdir()
    obj = "<object><name>{}</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>11</xmax><ymax>12</ymax></bndbox></object>"
    for name, objects in (("a", obj.format("cat") + obj.format("dog")), ("b", "")):
        (voc / f"{name}.xml").write_text(f"<annotation><filename>{name}.jpg</filename><size><width>20</width><height>30</height></size>{objects}</annotation>")
    got = sorted((r.image_id, r.name or "", r.width) for r in an.read_voc(spark, str(voc)).collect())
    assert got == [("a", "cat", 20), ("a", "dog", 20), ("b", "", 20)]


def test_class_table_and_tuning(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("names: {1: b, 0: a}\nclass_descriptions: {a: first}\n")
    assert [tuple(r) for r in an.read_class_table(spark, str(tmp_path / "d.yaml")).orderBy("class_id").collect()] == [(0, "a", "first"), (1, "b", None)]
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "results.csv").write_text("lr0, fitness\n0.1,0.5\n ,0.7\n")
    rows = an.read_tuning_history(spark, str(tmp_path / "runs")).orderBy("run_row").collect()
    assert [(r.lr0, r.fitness) for r in rows] == [("0.1", "0.5"), (None, "0.7")]


def test_images_features_and_corrupt(spark, tmp_path):
    rows = [[(x * 7 + y * 13) % 256 for x in range(9)] for y in range(8)]
    _png(tmp_path / "a.png", rows)
    (tmp_path / "bad.png").write_bytes(b"no image")
    found = {r.image_id: r for r in pixels.image_features(an.read_images(spark, str(tmp_path))).collect()}
    assert found["bad"].corrupt and found["bad"].lap_var is None
    import numpy as np

    assert not found["a"].corrupt and (found["a"].width, found["a"].height) == (9, 8)
    assert abs(found["a"].lap_var - pixels.laplacian_variance(np.array(rows, float))) < 1e-9
    boxes = an.read_images(spark, str(tmp_path)).withColumn("boxes", F.expr("array(named_struct('box_idx', 0L, 'x1', 0D, 'y1', 0D, 'x2', 1D, 'y2', 1D), named_struct('box_idx', 1L, 'x1', 50D, 'y1', 0D, 'x2', 60D, 'y2', 1D))"))
    assert [r.box_idx for r in pixels.occluded(boxes).collect()] == [0]


def test_variants_are_stable():
    import numpy as np

    a = np.arange(48, dtype=float).reshape(6, 8)
    assert (pixels.variant(a, "noise", "k") == pixels.variant(a, "noise", "k")).all()
    assert pixels.variant(a, "scale_12", "k").shape == (7, 10)
    assert (pixels.variant(pixels.variant(a, "flip", ""), "flip", "") == a).all()
    assert (pixels.preprocessed(a, 6, 8) == np.rint(a)).all()


def test_stream_of_label_files(spark, tmp_path):
    folder = tmp_path / "in" / "train"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.5 0.5 0.2 0.2\nbad\n")
    counts = class_counts(stream_label_lines(spark, str(folder)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("label_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("label_counts").collect()) == [(0, 1), (1, 1)]


def test_variant_and_preprocessed_images(spark, tmp_path):
    import numpy as np

    flat = [[100 + x for x in range(12)] for _ in range(10)]
    _png(tmp_path / "ok.PNG", flat)
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = pixels.grey_images(an.read_images(spark, str(tmp_path)))
    plan = spark.createDataFrame([("ok", "bright_7"), ("ok", "bright_7"), ("ok", "scale_12"), ("ok", "noise"), ("bad", "flip"), ("gone", "flip")], "image_id string, variant string")
    got = {r.variant: r for r in pixels.variant_images(images, plan).collect()}
    assert set(got) == {"bright_7", "scale_12", "noise"} and (got["scale_12"].height, got["scale_12"].width) == (12, 14)
    assert np.array_equal(np.frombuffer(got["bright_7"].pixels, np.uint8).reshape(10, 12), np.rint(np.array(flat) * 0.7))
    assert [r.pixels for r in pixels.variant_images(images, plan).where("variant = 'noise'").collect()] == [got["noise"].pixels]
    made = {r.image_id: r for r in pixels.preprocessed_images(images, 5, 23, smooth=True).collect()}
    assert made["bad"].pixels is None and made["bad"].error and made["ok"].error is None
    assert np.allclose(np.frombuffer(made["ok"].pixels, np.uint8).reshape(5, 23)[3], np.rint(np.linspace(100, 111, 23)))
    assert pixels.variant_images(images.limit(0), plan).count() == pixels.preprocessed_images(images.limit(0), 4, 4).count() == 0


def test_dataset_config_and_reports(spark, tmp_path):
    config = {"path": "data", "train": "train", "nc": 2, "names": {0: "cat", 1: "dog"}}
    an.write_dataset_config(config, str(tmp_path / "d.yaml"))
    assert [(r.class_id, r.name) for r in an.read_class_table(spark, str(tmp_path / "d.yaml")).orderBy("class_id").collect()] == [(0, "cat"), (1, "dog")]
    rows = spark.createDataFrame([(i, "x") for i in range(30)], "k int, v string")
    an.write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 30
    assert len(an.report_text(rows, "title").splitlines()) == 21
