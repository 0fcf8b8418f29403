import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import clips, intervals, lookups, split

TRACKS = "camera_id string, video_id string, frame_begin bigint, frame_end bigint, label string, frames_count bigint"


def test_subsample_frames(spark):
    tracks = spark.createDataFrame([("c", "v1", 1, 2, "A", 10), ("c", "v1", 5, 5, "Resting", 10), ("c", "v1", 2, 2, "A", 10)], TRACKS)
    (r,) = intervals.subsample_frames(tracks).collect()
    assert r.target_frames == [1, 2, 5]
    assert r.label_counts == {"A": 3, "Resting": 1} and r.frames_count == 10


def test_target_frames_of_overlapping_tracks_match_a_set(spark):
    rng = np.random.default_rng(0)
    rows = [("c", f"v{rng.integers(4)}", int(b), int(b + rng.integers(-2, 12)), "A", 99) for b in rng.integers(1, 60, 80)]
    want = {}
    for _, v, b, e, *_ in rows:
        want.setdefault(v, set()).update(range(b, e + 1))
    got = {r.video_id: r.target_frames for r in intervals.target_frames(spark.createDataFrame(rows, TRACKS)).collect()}
    assert got == {v: sorted(f) for v, f in want.items() if f}


def test_rest_sampling(spark):
    guidance = spark.createDataFrame([("c", "v1", [1, 2], {"A": 2, "B": 0}, 5), ("c", "v2", [1, 2, 3], {"A": 9, "B": 0}, 5)],
                                     "camera_id string, video_id string, target_frames array<bigint>, label_counts map<string,bigint>, frames_count bigint")
    got = {r.video_id: r for r in intervals.sample_rest_frames(guidance, 42).collect()}
    assert got["v1"].added_rests == 2 and len(got["v1"].target_frames) == 4 and set(got["v1"].target_frames[2:]) <= {3, 4, 5}
    assert got["v2"].added_rests == 2 and sorted(got["v2"].target_frames) == [1, 2, 3, 4, 5]


def test_split_sizes_round_half_to_even_and_do_not_leak(spark):
    videos = spark.createDataFrame([(f"c{i}", f"v{i}", f"/x/c{i}/v{i}.mp4", 10, 1.0) for i in range(10)],
                                   "camera_id string, video_id string, video_path string, frames_count bigint, duration double")
    tracks = spark.createDataFrame([(f"c{i}", f"v{i}", 1, 3, "A") for i in range(10)], "camera_id string, video_id string, frame_begin bigint, frame_end bigint, label string")
    sizes = dict(intervals.camera_splits(videos, (0.7, 0.15, 0.15), 1).groupBy("split").count().collect())
    assert sizes == {"train": 7, "val": 2, "test": 1}
    out = split.split_guidance(videos, tracks, (0.5, 0.5, 0.0)).collect()
    assert {r.split for r in out} == {"train", "val"} and len(out) == 10
    out = split.split_guidance(videos, tracks, (0.7, 0.15, 0.15)).collect()
    assert all((r.label_counts is None) == (r.split == "test") for r in out)
    assert all(r.target_frames == list(range(1, 11)) for r in out if r.split == "test")
    with_rests = split.split_guidance(videos, tracks, (0.7, 0.15, 0.15), sample_rests=True).filter("split = 'train'").first()
    assert with_rests.added_rests == 3 and len(with_rests.target_frames) == 6


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_smoothing_is_a_zero_padded_convolution(spark, n):
    x = np.arange(1, n + 1, dtype=float) ** 2
    rows = spark.createDataFrame([("t", i, float(v), float(-v)) for i, v in enumerate(x)], "track_id string, frame bigint, xc double, yc double")
    several = rows.withColumn("line_no", F.lit(0)).unionByName(rows.filter("frame = 0").withColumns({"xc": F.lit(9.0), "line_no": F.lit(1)}))
    both = {(r.frame, r.line_no): r.smooth_xc for r in intervals.smooth_centers(several, ["track_id"], line="line_no").collect()}
    got = [r.smooth_xc for r in intervals.smooth_centers(rows, ["track_id"]).orderBy("frame").collect()]
    assert [both[f, 0] for f in sorted(f for f, n in both if n == 0)] == got and both[0, 1] == (got[0] if n > 1 else 9.0)
    k = min(5, n)
    want = np.convolve(x, np.ones(k) / k, mode="same") if n > 1 else x
    assert np.allclose(got, want)


def test_clip_count_formula(spark):
    rows = [("t%d" % n, i * 3) for n in (5, 15, 16, 17, 24, 40, 41) for i in range(n)]
    got = clips.sliding_clips(spark.createDataFrame(rows, "track_id string, frame bigint"), ["track_id"])
    counts = {r.track_id: (r.clips, r.rows) for r in got.groupBy("track_id").agg(F.countDistinct("clip_idx").alias("clips"), F.count("*").alias("rows")).collect()}
    assert counts == {f"t{n}": ((n - 16) // 8 + 1, 16 * ((n - 16) // 8 + 1)) for n in (16, 17, 24, 40, 41)}


def test_interpolation_fills_between_keyframes(spark):
    rows = spark.createDataFrame([("t", 1, 0.0, 0.0, 1.0, 1.0), ("t", 5, 4.0, 8.0, 1.0, 3.0)], "track_id string, frame bigint, x double, y double, width double, height double")
    got = [(r.frame, r.x, r.y, r.height) for r in intervals.interpolate_keyframes(rows, ["track_id"]).orderBy("frame").collect()]
    assert got == [(1, 0, 0, 1), (2, 1, 2, 1.5), (3, 2, 4, 2), (4, 3, 6, 2.5), (5, 4, 8, 3)]


def test_too_few_random_frames_is_an_error(spark):
    videos = spark.createDataFrame([("c", "v", 2)], "camera_id string, video_id string, frames_count bigint")
    assert intervals.random_frames(videos, 2, 1).first().frames == [1, 2]
    with pytest.raises(Exception, match="fewer frames"):
        intervals.random_frames(videos, 3, 1).collect()


def test_lookup_finds_one_row_or_fails(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "name string, id int")
    assert tuple(lookups.lookup_one(rows, "name", "a", ["id"]).first()) == ("a", 1)
    with pytest.raises(Exception, match="no row with name = z"):
        lookups.lookup_one(rows, "name", "z").collect()
    assert lookups.pick_one(rows, 1, ["id"]).count() == 1
