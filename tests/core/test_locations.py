"""Quadtree point location, cogrouped crops and bucketed joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import clips, images, intervals, masks, quadtree
from tracklens.sources import sinks

RUNS = "video_id bigint, segment_idx bigint, cage_id string, cage_ord int, y int, x0 int, x1 int"


def invented_runs(rng, height, width, videos=2, cages=3):
    rows = []
    for v in range(videos):
        for c in range(cages):
            top, left = rng.randrange(height), rng.randrange(width)
            for y in range(top, min(height, top + rng.randrange(1, height))):
                x0 = max(0, left + rng.randrange(-2, 3))
                if x0 < width:
                    rows.append((v, 0, f"c{c}", c, y, x0, min(width - 1, x0 + rng.randrange(width // 2 + 1))))
    return rows


@pytest.mark.parametrize("height,width,level", [(8, 8, 0), (8, 8, 1), (33, 50, 3), (40, 17, 5)])
def test_quadtree_finds_what_rows_find(spark, height, width, level):
    rng = random.Random(height + level)
    runs = spark.createDataFrame(invented_runs(rng, height, width), RUNS)
    points = spark.createDataFrame([(k, k % 3, 0, rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)) for k in range(600)], "p int, video_id bigint, segment_idx bigint, mean_x double, mean_y double")
    keys = ["video_id", "segment_idx"]
    by_rows = masks.cages_of_points(points, runs, keys, height, width)
    by_tree = quadtree.cages_by_quadtree(points, quadtree.quadtree(runs, keys, level), keys, height, width, level)
    assert sorted(by_tree.select("p", "cage_id").collect()) == sorted(by_rows.select("p", "cage_id").collect())


def test_cells_cover_a_mask_once():
    rng = np.random.default_rng(2)
    mask = rng.random((37, 70)) < 0.7
    mask[16:32, 16:48] = True
    low, high = (np.concatenate(p) for p in zip(*quadtree.cells_of(mask, 4)))
    codes = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])
    y, x = np.nonzero(mask)
    assert len(codes) == len(set(codes)) and set(codes) == set(quadtree._morton(x, y)) and (high - low).max() == 255
    assert len(low) < len(codes)


def test_a_million_tracks_of_one_video_spread(spark):
    """Tasks of the join hold about as many tracks each, though all are in one video and segment."""
    points = spark.range(200_000).selectExpr("id p", "1L video_id", "0L segment_idx", "rand(1) mean_x", "rand(2) mean_y")
    cx, cy = masks.point_cell(F.col("mean_x"), F.col("mean_y"), 1080, 1920)
    chunk = F.call_function("shiftright", quadtree.morton(cx, cy), F.lit(2 * quadtree.CHUNK_LEVEL))
    sizes = [r["count"] for r in points.select("video_id", "segment_idx", chunk.alias("chunk")).repartition(16, "video_id", "segment_idx", "chunk").groupBy(
        F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]


def test_an_image_is_moved_once_for_all_its_crops(spark):
    pixels = np.arange(6 * 7 * 3, dtype=np.uint8).reshape(6, 7, 3)
    shots = spark.createDataFrame([(1, f, f"i{f}", 6, 7, 3, 16, bytearray(pixels.tobytes())) for f in range(4)], f"video_id bigint, frame bigint, {images.IMAGE}")
    crops = [(1, f, f"c{c}", c, 1, c + 2, 4, [(y, c, c + 1 + y % 2) for y in range(6)]) for f in (0, 1, 9) for c in range(3)]
    crops = spark.createDataFrame(crops, "video_id bigint, frame bigint, cage_id string, x_min bigint, y_min bigint, x_max bigint, y_max bigint, runs array<struct<y: int, x0: int, x1: int>>")
    keys = ["video_id", "frame"]
    whole = crops.join(shots, keys).withColumn("origin", F.concat("origin", F.lit("_cage_"), "cage_id"))
    for black_out in (True, False):
        once = images.cut_images(shots, crops, keys, black_out)
        assert sorted(once.collect()) == sorted(images.crop_images_mask(whole, black_out).collect()) and once.count() == 6
    plan = images.cut_images(shots, crops, keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the images, and the crops


def test_bucketed_tables_join_where_they_lie(spark, tmp_path):
    videos = spark.range(40).selectExpr("concat('c', id % 5) camera_id", "concat('v', id) video_id", "concat('/p/', id) video_path", "50L frames_count", "if(id % 2 = 0, 'train', 'test') split")
    tracks = spark.range(900).selectExpr("string(id) track_id", "concat('c', id % 5) camera_id", "concat('v', id % 45) video_id", "'x' label", "id % 40 frame_begin", "id % 40 + 5 frame_end")
    plain = clips.clip_index(tracks, videos, videos.select("video_path", "split"))
    stored = [sinks.write_bucketed(df, f"t_{name}", str(tmp_path / name), buckets=8) for name, df in (("tracks", tracks), ("videos", videos), ("guidance", videos))]
    bucketed = clips.bucketed_clip_index(*stored)
    assert sorted(bucketed.collect()) == sorted(plain.collect()) and bucketed.count() == 800
    assert "Exchange" not in bucketed._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buffered = intervals.buffer_tracks(stored[0], stored[1], 16)
        assert "Exchange" not in buffered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(buffered.collect()) == sorted(intervals.buffer_tracks(tracks, videos, 16).select(buffered.columns).collect())
