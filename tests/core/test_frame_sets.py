"""Keyed draws, frame sets as bitmaps and observed quality against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tracklens.functions.draws import permuted
from tracklens.operators import frame_sets, intervals
from tracklens.sources import sinks

KEYS = ["camera_id", "video_id"]
TRACKS = "camera_id string, video_id string, label string, frame_begin bigint, frame_end bigint"


def test_a_permutation_for_every_length(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 100, 1000]
    rows = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n bigint, x bigint")
    got = collections.defaultdict(list)
    for r in rows.select("n", "x", permuted(F.col("x"), F.col("n"), F.lit("k")).alias("y")).collect():
        got[r.n].append((r.x, r.y))
    for n in sizes:
        assert sorted(y for _, y in got[n]) == list(range(n))
    assert [y for _, y in sorted(got[1000])] != list(range(1000))


def test_draws_are_uniform(spark):
    videos = spark.range(6000).selectExpr("'c' camera_id", "concat('v', id) video_id", "10L frames_count")
    drawn = intervals.draw_frames(videos, 3, 7)
    counts = {r.frame: r["count"] for r in drawn.groupBy("frame").count().collect()}
    assert set(counts) == set(range(1, 11)) and all(abs(n - 1800) < 200 for n in counts.values())
    assert drawn.groupBy("video_id").agg(F.count_distinct("frame").alias("n")).filter("n <> 3").count() == 0
    # pairs too: every pair of frames 1..10 is about as likely as another
    pairs = drawn.filter("draw < 2").groupBy("video_id").agg(F.sort_array(F.collect_list("frame")).alias("p")).groupBy("p").count().collect()
    assert len(pairs) == 45 and all(80 < r["count"] < 190 for r in pairs)


def test_draws_at_the_limits(spark):
    videos = spark.createDataFrame([("c", "one", 1), ("c", "five", 5), ("c", "day", 2_600_000_000)], "camera_id string, video_id string, frames_count bigint")
    assert [tuple(r) for r in intervals.draw_frames(videos.filter("video_id = 'one'"), 1, 1).collect()] == [("c", "one", 0, 1)]
    assert sorted(r.frame for r in intervals.draw_frames(videos.filter("video_id = 'five'"), 5, 1).collect()) == [1, 2, 3, 4, 5]
    day = [r.frame for r in intervals.draw_frames(videos.filter("video_id = 'day'"), 200, 1).collect()]
    assert len(set(day)) == 200 and all(1 <= f <= 2_600_000_000 for f in day) and max(day) > 1 << 31
    assert intervals.draw_frames(videos, 0, 1).count() == 0
    with pytest.raises(Exception, match="fewer frames than asked for"):
        intervals.draw_frames(videos, 2, 1).collect()


def test_rests_are_drawn_from_the_gaps(spark):
    rng = random.Random(3)
    rows, videos = [], []
    for v in range(25):
        count = rng.choice([5, 40, 300])
        videos.append(("c", f"v{v}", count))
        for _ in range(rng.randrange(5)):
            begin = rng.randrange(-5, count + 5)
            rows.append(("c", f"v{v}", rng.choice("AB"), begin, begin + rng.randrange(-1, 60)))
    tracks, table = spark.createDataFrame(rows, TRACKS), spark.createDataFrame(videos, "camera_id string, video_id string, frames_count bigint")
    got = collections.defaultdict(list)
    for r in intervals.draw_rests(tracks, table, 5).collect():
        got[r.video_id].append(r.frame)
    for _, v, count in videos:
        own = [r for r in rows if r[1] == v]
        labels = collections.Counter()
        for _, _, label, begin, end in own:
            labels[label] += max(0, end - begin + 1)
        free = set(range(1, count + 1)) - {f for r in own for f in range(r[3], r[4] + 1)}
        inside = any(r[3] <= r[4] and r[3] <= count and r[4] >= 1 for r in own)
        assert set(got[v]) <= free and len(got[v]) == len(set(got[v]))
        assert len(got[v]) == (min(max(labels.values(), default=0), len(free)) if inside else 0)


def test_bitmaps_as_sets(spark):
    rng = random.Random(6)
    edges = [0, 1, 7, 8, 9, 32_767, 32_768, 65_535, 65_536, 70_000]
    rows = [("c", f"v{v}", "x", b := rng.choice(edges), b + rng.choice([-1, 0, 1, 6, 7, 8, 40, 33_000, 70_000])) for v in range(4) for _ in range(4)] + [("c", "v0", "x", -9, 3)]
    frames = [("c", f"v{v}", rng.choice(edges) + rng.randrange(10)) for v in range(5) for _ in range(40)]
    a, b = frame_sets.covered_bitmaps(spark.createDataFrame(rows, TRACKS)), frame_sets.frame_bitmaps(spark.createDataFrame(frames, "camera_id string, video_id string, frame bigint"))
    left = {(r[1], f) for r in rows for f in range(max(0, r[3]), r[4] + 1)}
    right = {(v, f) for _, v, f in frames}
    shown = lambda sets: [(r.video_id, r.frame) for r in frame_sets.frames_of(sets).collect()]
    for sets, expected in ((a, left), (b, right), (frame_sets.union(a, b), left | right), (frame_sets.difference(a, b), left - right), (frame_sets.difference(b, a), right - left)):
        got = shown(sets)
        assert len(got) == len(set(got)) and set(got) == expected
        assert {r.video_id: r.n for r in frame_sets.counts(sets).collect()} == collections.Counter(v for v, _ in expected)
    assert frame_sets.difference(a, a).count() == 0


def test_a_video_of_ten_million_frames(spark):
    tracks = spark.createDataFrame([("c", "v", "A", 1, 9_000_000), ("c", "v", "B", 8_999_000, 10_000_000), ("c", "v", "B", 10_000_000, 10_000_000)], TRACKS)
    whole = spark.createDataFrame([("c", "v", "A", 0, 10_000_100)], TRACKS)
    covered = frame_sets.covered_bitmaps(tracks)
    assert covered.agg(F.max(F.length("bits")), F.count("*")).first() == (frame_sets.BYTES, 306)
    assert [r.n for r in frame_sets.counts(covered).collect()] == [10_000_000]
    rest = frame_sets.difference(frame_sets.covered_bitmaps(whole), covered)
    assert sorted(r.frame for r in frame_sets.frames_of(rest).collect()) == [0, *range(10_000_001, 10_000_101)]


def test_quality_is_observed_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "n int, s string")
    findings = {"missing": F.col("s").isNull(), "large": F.col("n") > 1}
    assert sinks.write_observed(rows, str(tmp_path / "a"), findings) == {"missing": 1, "large": 2}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    with pytest.raises(Exception, match="a row is missing"):
        sinks.write_observed(rows, str(tmp_path / "b"), findings, fatal=("missing",))
    assert not (tmp_path / "b" / "_SUCCESS").exists()
    assert sinks.write_observed(rows.limit(0), str(tmp_path / "c"), findings) == {"missing": 0, "large": 0}
