import json
import random

from pyspark.sql import functions as F

from tracklens.functions import numbers
from tracklens.operators import boxes, intervals, labels
from tracklens.sources import readers, schemas

TASK = {
    "inner_id": 1, "total_annotations": 1,
    "data": {"video": "/data/set/K3%2CL9/12.mp4", "framesCount": 90, "duration": 3.0},
    "annotations": [{"id": 1, "result": [{"id": "r1", "value": {"labels": ["bird"], "sequence": [
        {"frame": 2, "x": 12, "y": 18, "width": 24, "height": 36}]}}]}],
}
META = "camera_id string, video_id string, true_fps double, frame_count bigint"


def test_label_tables_of_one_task(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([TASK, TASK | {"inner_id": 2, "total_annotations": 0}]))
    tasks = readers.read_annotations(spark, str(tmp_path))
    meta = spark.createDataFrame([("K3,L9", "12", 15.0, 45)], META)
    videos, tracks = labels.label_tables(tasks, meta)
    (v,) = videos.collect()
    assert (v.camera_id, v.video_id, v.video_ext, v.frames_count) == ("K3,L9", "12", "mp4", 45)
    (t,) = tracks.collect()
    assert (t.frame_begin, t.frame_end) == (1, 45)
    assert [round(x, 6) for x in (t.mean_x, t.mean_y, t.mean_width, t.mean_height)] == [0.24, 0.36, 0.24, 0.36]


def test_empty_results_keep_a_row_and_null_frames_go(spark, tmp_path):
    empty = TASK | {"inner_id": 3, "annotations": [{"id": 1, "result": []}]}
    (tmp_path / "b.json").write_text(json.dumps([empty]))
    results = labels.flatten_results(readers.read_annotations(spark, str(tmp_path)))
    assert [r.track_id for r in results.collect()] == [None]
    assert labels.keyframes(results).count() == 0


def test_buffering(spark):
    videos = spark.createDataFrame([("c", "v", 100)], "camera_id string, video_id string, frames_count bigint")
    rows = [("mid", 50, 52), ("early", 1, 3), ("zero", 8, 8), ("late", 99, 100), ("long", 10, 60)]
    tracks = spark.createDataFrame([("c", "v", *r) for r in rows], "camera_id string, video_id string, track_id string, frame_begin bigint, frame_end bigint")
    got = {r.track_id: (r.frame_begin, r.frame_end) for r in intervals.buffer_tracks(tracks, videos, 16).collect()}
    assert got["mid"] == (43, 59) and got["long"] == (10, 60)
    # begin 1 - 7 = -6, so 7 frames are added at the end
    assert got["early"] == (1, 17)
    assert got["zero"] == (1, 16)
    assert got["late"] == (85, 100)
    strict = {r.track_id: (r.frame_begin, r.frame_end) for r in intervals.buffer_tracks(tracks, videos, 16, strict=True).collect()}
    assert strict["zero"] == (1, 17)
    assert all(1 <= b and e <= 100 and e - b + 1 >= 16 for b, e in strict.values())
    unknown = intervals.buffer_tracks(tracks.withColumn("video_id", F.lit("w")), videos, 16).filter("track_id = 'late'").first()
    assert (unknown.frame_begin, unknown.frame_end) == (92, 107)


def test_expansion_of_reversed_intervals_is_empty(spark):
    rows = spark.createDataFrame([(5, 4), (2, 3)], "frame_begin bigint, frame_end bigint")
    assert sorted(r.frame for r in intervals.expand_frames(rows).collect()) == [2, 3]


def test_fps_rescale_truncates(spark):
    rows = spark.createDataFrame([(3, 7, 30.0, 25.0)], "frame_begin bigint, frame_end bigint, true_fps double, ls_fps double")
    got = labels.rescale_frames(rows).first()
    assert (got.frame_begin, got.frame_end) == (3, 8)


def test_rest_truncation_can_lengthen(spark):
    rows = spark.createDataFrame([("Resting", 5, 6), ("Other", 5, 6)], "label string, frame_begin bigint, frame_end bigint")
    got = {r.label: r.frame_end for r in labels.truncate_rests(rows).collect()}
    assert got == {"Resting": 20, "Other": 6}


def test_frames_in_arrays_are_not_moved_as_rows(spark):
    from pyspark.sql import functions as F

    from tracklens.operators import boxes

    targets = spark.createDataFrame(
        [("c", "v", list(range(0, 3000, 3)) + [7, 7], 25.0, 30.0), ("c", "w", [5, None], 25.0, 25.0), ("d", "v", [], 25.0, 25.0)],
        "camera_id string, video_id string, target_frames array<bigint>, ls_fps double, fps double")
    keyframes = spark.createDataFrame(
        [("c", "v", f"t{k}", f, 1.0, 2.0, 3.0, 4.0) for k in range(3) for f in range(0, 2600, 1 + 2 * k)] + [("c", "x", "t", 5, 1.0, 2.0, 3.0, 4.0)],
        "camera_id string, video_id string, track_id string, frame bigint, x double, y double, width double, height double")
    keys = ["camera_id", "video_id"]
    rows = targets.withColumn("frame", F.explode("target_frames")).drop("target_frames")
    for how in ("left", "inner"):
        whole, arrays = boxes.box_lines(rows, keyframes, keys, how), boxes.box_lines(targets, keyframes, keys, how)
        columns = whole.columns
        assert sorted(map(str, whole.select(*columns).collect())) == sorted(map(str, arrays.select(*columns).collect()))
        plan = arrays._jdf.queryExecution().optimizedPlan().toString()
        # frames become rows above the join
        assert plan.index("explode(target_frames") < plan.index("Join") if how == "left" else "explode(target_frames" not in plan


def test_label_tables_move_tracks_once_and_keep_videos_of_one_name(spark):
    result = lambda k, begin: (k, (["Foraging"], [(begin, 10.0, 20.0, 30.0, 40.0), (begin + 30, 20.0, 20.0, 30.0, 40.0)]))
    task = lambda labeler, k, path, *results: (labeler, k, 1, (path, 100, 4.0), [(1, list(results))])
    path = "/data/H1%2CI1/v1.mp4"
    tasks = spark.createDataFrame(
        [task("a", 1, path, result("t1", 3)), task("b", 1, path, result("t2", 4)), task("a", 2, "/data/H2%2CI1/v2.mp4", result("t3", 5)),
         task("a", 3, None, result("t4", 6)), task("b", 3, None), task("a", 4, path)], f"labeler string, {schemas.TASKS}")
    meta = spark.createDataFrame([("H1,I1", "v1", 25.0, 20)], schemas.VIDEO_META)
    videos, tracks = labels.label_tables(tasks, meta)
    assert videos.count() == 6
    got = sorted((r.track_id, r.frame_begin, r.frame_end) for r in tracks.select("track_id", "frame_begin", "frame_end").collect())
    assert got == sorted([("t1", 1, 20)] * 3 + [("t2", 1, 20)] * 3 + [("t3", 1, None), ("t4", 1, None)], key=lambda r: r[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = labels.label_tables(tasks, meta)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("explode(") == 3  # results are taken apart for tracks only


def test_target_stretches_give_what_their_frames_give(spark):
    rng = random.Random(8)
    key = lambda k: (f"c{k % 3}", f"v{k}")
    rates = [(25.0, 24.0), (25.0, 36.0), (10.0, 30.0), (30.0, 7.5), (29.97, 59.94), (0.0, 25.0), (25.0, None)]
    stretches = [(*key(k), *span, *rates[k % 7]) for k in range(42) for span in ((1, 90), (5, 4), (-40, 12), (500, 900))[k % 4:k % 4 + 2]]
    targets = spark.createDataFrame(stretches, "camera_id string, video_id string, frame_begin bigint, frame_end bigint, ls_fps double, fps double")
    boxes_at = [(*key(rng.randrange(44)), f"t{n}", rng.choice([0, 1, rng.randrange(-40, 60), rng.randrange(900)]), 1.0, 2.0, 3.0, 4.0) for n in range(3000)]
    keyframes = spark.createDataFrame(boxes_at, "camera_id string, video_id string, track_id string, frame bigint, x double, y double, width double, height double")
    rows = targets.withColumn("frame", F.explode(numbers.frames_between(F.col("frame_begin"), F.col("frame_end")))).drop("frame_begin", "frame_end")
    for how in ("left", "inner"):
        got = boxes.box_lines(targets, keyframes, ["camera_id", "video_id"], how)
        want = boxes.box_lines(rows, keyframes, ["camera_id", "video_id"], how).select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.filter("track_id is not null").count() > 1000
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        # frames become rows above the join
        assert "sequence(greatest(frame_begin" not in plan[plan.index("Join"):]


def test_tasks_meet_target_stretches_whole(spark):
    rng = random.Random(5)
    frame = lambda: (rng.choice([None, rng.randrange(-3, 90)]), 1.0, 2.0, 3.0, 4.0)
    result = lambda n: rng.choice([None, (f"r{n}", None), (f"r{n}", (["b"], None)), *[(f"r{n}", (["b"], [frame() for _ in range(4)]))] * 5])
    rows = [(n, 1, (f"/d/c{n % 3}/v{n % 11}.mp4", 90, 3.0), rng.choice([None, [(1, None)], *[[(k, [result(10 * n + k) for _ in range(2)]) for k in range(2)]] * 5]))
            for n in range(200)]
    tasks = spark.createDataFrame(rows, schemas.TASKS)
    targets = spark.createDataFrame([(f"c{k % 3}", f"v{k % 11}", 1, 40 + k, 25.0, 20.0 + k) for k in range(30)],
                                    "camera_id string, video_id string, frame_begin bigint, frame_end bigint, ls_fps double, fps double")
    got = boxes.task_lines(tasks, targets)
    want = boxes.box_lines(targets, boxes.task_keyframes(tasks), ["camera_id", "video_id"], how="inner").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Generate" not in plan[plan.index("Join"):]
