import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracklens.functions import boxes, paths
from tracklens.operators import labels
from tracklens.operators.boxes import square_crops
from tracklens.sources import readers, sinks
from tracklens.streaming.ingest import annotation_stream, ingest_annotations, ingested_lines


def test_paths(spark):
    rows = spark.createDataFrame([("/d/K3%2CL9/1.5(b).x.mp4",), ("v.mp4",)], "p string")
    a, b = rows.select(
        paths.camera_id(F.col("p")).alias("cam"), paths.video_id(F.col("p")).alias("v"), paths.video_id(F.col("p"), True).alias("first"),
        paths.camera_stem(F.lit("/d/a.b/v.mp4")).alias("stem"), paths.label_folder(F.lit("Eat/Drink Now")).alias("l"),
        paths.without_ordinal(F.lit("x_12")).alias("w")).collect()
    assert (a.cam, a.v, a["first"], a.stem, a.l, a.w) == ("K3,L9", "1.5(b).x", "1", "a", "eat_drink_now", "x")
    assert (b.cam, b.v) == (None, "v")
    with pytest.raises(Exception, match="no frame number"):
        rows.select(paths.frame_from_name(F.col("p"))).collect()


def test_pixel_corners(spark):
    for size, want in (((0.5, 100, 80), (25, 20, 75, 60)), ((0.2, 250, 100), (100, 40, 150, 60))):
        s, w, h = size
        cols = boxes.pixel_corners(F.lit(0.5), F.lit(0.5), F.lit(s), F.lit(s), w, h)
        got = spark.range(1).select(*(cols[c].alias(c) for c in ("px1", "py1", "px2", "py2"))).first()
        assert all(abs(a - b) <= 1 for a, b in zip(got, want))


def test_label_text_round_trip(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c.v_frame_00007_cage_x.txt").write_text("0 0.5 0.25 0.1 0.2\n\nbad\n1 0.1 0.1 0.1 0.1 0.9 4\n")
    (tmp_path / "a" / "empty.txt").write_text("")
    rows = readers.read_box_labels(spark, str(tmp_path)).withColumn("frame", paths.frame_from_name(F.col("stem"))).orderBy("line_no").collect()
    assert [(r.frame, r.class_id, r.xc) for r in rows] == [(7, 0, 0.5), (7, 1, 0.1)]
    (t,) = readers.read_tracking_labels(spark, str(tmp_path)).collect()
    assert (t.conf, t.track_id) == (0.9, 4)
    lines = spark.createDataFrame([(1, 0, 0, 0.25, 0.4, 0.3, 0.4), (1, 1, 0, 0.85, 1.0, 0.7, 0.8)], "frame bigint, line_no bigint, class_id int, xc double, yc double, w double, h double")
    frames = spark.createDataFrame([(1,), (2,)], "frame bigint")
    got = {r.frame: r.body for r in sinks.box_label_files(lines, frames, ["frame"]).collect()}
    assert got == {1: "0 0.250000 0.400000 0.300000 0.400000\n0 0.850000 1.000000 0.700000 0.800000", 2: ""}


def test_mask_json_and_segment_index(spark, tmp_path):
    (tmp_path / "0_segmentation.json").write_text(json.dumps({"c2": [[True, False]], "c1": [[False, True]]}, indent=1))
    (tmp_path / "1_segmentation.json").write_text(json.dumps({"c1": [[[True, True]]]}))
    (tmp_path / "2_segmentation.json").write_text("{broken")
    (tmp_path / "segment_index.json").write_text(json.dumps({"0": {"start": 0, "end": 4}, "1": {"start": 5, "end": 9}}, indent=1))
    got = {(r.path[-19:][0], r.cage_id): (r.cage_ord, r.mask) for r in readers.read_mask_json(spark, str(tmp_path)).collect()}
    assert got == {("0", "c2"): (0, [[True, False]]), ("0", "c1"): (1, [[False, True]]), ("1", "c1"): (0, [[True, True]])}
    segments = readers.read_segment_index(spark, str(tmp_path))
    assert sorted((r.segment_idx, r.start, r.end) for r in segments.collect()) == [(0, 0, 4), (1, 5, 9)]
    body = sinks.segment_index_json(segments.withColumn("v", F.lit(1)), ["v"]).first().body
    assert json.loads(body) == {"0": {"start": 0, "end": 4}, "1": {"start": 5, "end": 9}}


def test_file_listing_ignores_case(spark, tmp_path):
    for n in ("a.MP4", "b.txt", "c.mkv"):
        (tmp_path / n).write_text("x")
    assert sorted(r.path[-5:] for r in readers.list_files(spark, str(tmp_path)).collect()) == ["a.MP4", "c.mkv"]


def test_stream_ingest_adds_nothing_when_run_again(spark, tmp_path):
    task = {"inner_id": 1, "total_annotations": 1, "data": {"video": "/d/c1/v1.mp4", "framesCount": 2, "duration": 1.0},
            "annotations": [{"id": 1, "result": [{"id": "r", "value": {"labels": ["b"], "sequence": [
                {"frame": 1, "x": 20, "y": 10, "width": 40, "height": 60}, {"frame": 2, "x": 50, "y": 30, "width": 20, "height": 10}]}}]}]}
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(json.dumps(task) + "\n")
    targets = spark.createDataFrame([("c1", "v1", f, 10.0, 10.0) for f in (1, 2, 3)], "camera_id string, video_id string, frame bigint, ls_fps double, fps double")
    sink = str(tmp_path / "out")
    for checkpoint in ("k1", "k2"):
        query = ingest_annotations(annotation_stream(spark, str(source)), targets, sink, str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert query.exception() is None
    rows = ingested_lines(spark, sink, targets).orderBy("frame").collect()
    assert [(r.frame, r.xc, r.yc) for r in rows] == [(1, 0.4, 0.4), (2, 0.6, 0.35), (3, None, None)]
    # another task of the same video in a later batch adds its boxes, also to frames that were empty or taken
    other = json.loads(json.dumps(task))
    other["annotations"][0]["result"][0] |= {"id": "r2"}
    other["annotations"][0]["result"][0]["value"]["sequence"] = [{"frame": 2, "x": 0, "y": 0, "width": 20, "height": 20}, {"frame": 3, "x": 0, "y": 0, "width": 40, "height": 40}]
    (source / "2.json").write_text(json.dumps(other) + "\n")
    ingest_annotations(annotation_stream(spark, str(source), max_files=1), targets, sink, str(tmp_path / "k1")).awaitTermination(120)
    rows = ingested_lines(spark, sink, targets).orderBy("frame", "track_id").collect()
    assert [(r.frame, r.track_id, r.xc) for r in rows] == [(1, "r", 0.4), (2, "r", 0.6), (2, "r2", 0.1), (3, "r2", 0.2)]


def test_lines_are_numbered_within_their_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"0 0.{i + 1} 0.5 0.1 0.1\n\n" for i in range(n)))
    lines = readers.read_box_labels(spark, str(tmp_path))
    crops = square_crops(lines, ["stem"], 100, 100, 10)
    got = sorted((r.stem, r.line_no, r.xc, r.suffix) for r in crops.collect())
    assert got == [("a", 0, 0.1, "_bird_0"), ("a", 1, 0.2, "_bird_1"), ("a", 2, 0.3, "_bird_2"), ("b", 0, 0.1, "_bird_0"),
                   ("b", 1, 0.2, "_bird_1"), ("c", 0, 0.1, "")]


def test_image_files_are_decoded(spark, tmp_path):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes([10 * y + x for x in range(3)]) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png)
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    (image,) = readers.read_images(spark, str(tmp_path)).select("image.*").collect()
    assert (image.height, image.width, image.nChannels, bytes(image.data)) == (2, 3, 1, bytes([0, 1, 2, 10, 11, 12]))


def test_names(spark):
    rows = spark.createDataFrame([("a.b.mp4",), ("a.",), (".x",), ("a",)], "n string")
    got = [tuple(r) for r in rows.select(paths.strip_extension(F.col("n")), paths.file_stem(F.col("n"))).collect()]
    assert got == [("a.b", "a.b"), ("a.", "a."), ("", ".x"), ("a", "a")]
    (clip,) = spark.range(1).select(paths.clip_name(F.lit("t"), F.lit(7), F.lit("c1"))).first()
    assert clip == "t_c1_clip007"


def test_strict_union_wants_equal_shapes(spark):
    a, b = spark.createDataFrame([(1, "x")], "n bigint, s string"), spark.createDataFrame([("x", 1)], "s string, n bigint")
    assert labels.strict_union([a, b, a]).collect() == [(1, "x")] * 3
    with pytest.raises(ValueError, match="table 2"):
        labels.strict_union([a, b.withColumn("n", F.col("n").cast("int"))])
