"""Split guidance: which frames of which video go where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.numbers import ratio
from tracklens.operators.intervals import KEY, all_frames, camera_splits, sample_rest_frames, subsample_frames
from tracklens.operators.labels import relaxed_union


def guidance_fps(videos: DataFrame) -> DataFrame:
    return videos.withColumn("fps", ratio(F.col("frames_count"), F.col("duration")))


def split_guidance(
    videos: DataFrame, tracks: DataFrame, ratios: tuple[float, float, float], seed: int = 42, sample_rests: bool = False
) -> DataFrame:
    """``camera_id, video_id, video_path, fps, split, target_frames, label_counts`` (and ``added_rests``).

    No camera is in two splits. Test videos give all their frames, the others those that their tracks cover; only those
    carry label counts. Both branches are one plan over one assignment of cameras; no split is planned on its own.
    """
    cameras = camera_splits(videos, ratios, seed)
    assigned = guidance_fps(videos).join(cameras, "camera_id")
    shape = [*KEY, "video_path", "fps", "split"]
    test = all_frames(assigned.filter("split = 'test'")).select(*shape, "target_frames")
    labelled = assigned.filter("split <> 'test'")
    own = tracks.drop("frames_count").join(labelled.select(*KEY, "frames_count"), KEY)
    targets = subsample_frames(own)
    targets = sample_rest_frames(targets, seed) if sample_rests else targets.drop("frames_count")
    rest = labelled.select(*shape).join(targets, KEY)
    return relaxed_union([rest, test])


def all_frames_guidance(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Guidance for whole videos: every frame of every listed file that has metadata."""
    rows = files.join(meta, KEY).withColumnRenamed("frame_count", "frames_count")
    return all_frames(rows).select("video_path", F.col("true_fps").alias("fps"), "target_frames")


def one_guidance_per_video(guidance: DataFrame) -> DataFrame:
    """Videos with other than one guidance row; empty when the table is sound."""
    return guidance.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n <> 1")


def seed_videos(videos: DataFrame) -> DataFrame:
    """The reference video of each camera: its smallest id."""
    return videos.groupBy("camera_id").agg(F.min("video_id").alias("video_id"))
