"""From nested annotation tasks to video and track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import boxes, paths
from tracklens.functions.numbers import ratio, truncated
from tracklens.operators.intervals import KEY, buffer_counted

NUM_FRAMES = 16
REST = "Resting"


def annotated(tasks: DataFrame) -> DataFrame:
    return tasks.filter("total_annotations > 0")


def task_videos(tasks: DataFrame) -> DataFrame:
    """One row per task with what it tells about its video."""
    return tasks.select(
        "labeler", F.col("inner_id").alias("video_idx"), F.col("data.video").alias("video_path"),
        F.col("data.framesCount").alias("frames_count"), F.col("data.duration").alias("duration"))


def flatten_results(tasks: DataFrame) -> DataFrame:
    """One row per result of a task; a task without results keeps one row of nulls."""
    rows = tasks.select(
        "labeler", F.col("inner_id").alias("video_idx"), F.col("data.video").alias("video_path"),
        F.col("data.framesCount").alias("frames_count"), F.col("data.duration").alias("duration"),
        F.explode_outer("annotations").alias("a"))
    return rows.select("*", F.explode_outer("a.result").alias("r")).select(
        "labeler", "video_idx", "video_path", "frames_count", "duration", F.col("r.id").alias("track_id"),
        F.get(F.col("r.value.labels"), F.lit(0)).alias("label"), F.col("r.value.sequence").alias("sequence"))


def keyframes(results: DataFrame) -> DataFrame:
    """One row per keyframe with a frame number, boxes as normalised centre boxes."""
    rows = results.select("*", F.explode_outer("sequence").alias("k")).select(
        "labeler", "video_idx", "track_id", "label", "k.*", "frames_count").dropna(subset=["frame"])
    center = boxes.percent_corner_to_center(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return rows.select(
        "labeler", "video_idx", "track_id", "label", "frame",
        center["xc"].alias("x"), center["yc"].alias("y"), center["wn"].alias("width"), center["hn"].alias("height"), "frames_count")


def track_rollup(frames: DataFrame, keys: tuple[str, ...] = ("track_id",), frame_offset: int = 1) -> DataFrame:
    """One row per track: first and last frame, mean box, and what is constant in a track."""
    constant = [c for c in frames.columns if c not in {*keys, "frame", "x", "y", "width", "height"}]
    return frames.groupBy(*keys).agg(
        *(F.min(c).alias(c) for c in constant),
        (F.min("frame") + frame_offset).alias("frame_begin"), (F.max("frame") + frame_offset).alias("frame_end"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("x", "y", "width", "height")))


def extend_single_keyframes(tracks: DataFrame) -> DataFrame:
    """A track with one keyframe lasts to the end of the annotated video."""
    return tracks.withColumn(
        "frame_end", F.when(F.col("frame_begin") == F.col("frame_end"), F.col("frames_count")).otherwise(F.col("frame_end")))


def rescale_frames(tracks: DataFrame, columns: tuple[str, ...] = ("frame_begin", "frame_end")) -> DataFrame:
    """Annotation frames to container frames: the frame times ``true_fps / ls_fps``, toward zero."""
    return tracks.withColumns({c: truncated(F.col(c) * (F.col("true_fps") / F.col("ls_fps"))) for c in columns})


def truncate_rests(tracks: DataFrame, num_frames: int = NUM_FRAMES) -> DataFrame:
    """Resting tracks span exactly ``num_frames`` frames."""
    return tracks.withColumn(
        "frame_end", F.when(F.col("label") == REST, F.col("frame_begin") + num_frames - 1).otherwise(F.col("frame_end")))


def videos_of(results: DataFrame, meta: DataFrame, first_dot: bool = True) -> DataFrame:
    """One row per task with ids from its path, frame rates, and the container's frame count."""
    path = F.col("video_path")
    rows = results.select("labeler", "video_idx", "video_path", "frames_count", "duration").dropDuplicates(["labeler", "video_idx"])
    rows = rows.withColumns({
        "camera_id": paths.camera_id(path), "video_id": paths.video_id(path, first_dot), "video_ext": paths.extension(path),
        "ls_fps": ratio(F.col("frames_count"), F.col("duration"))})
    return rows.join(meta, ["camera_id", "video_id"], "left")


def strict_union(tables: list[DataFrame]) -> DataFrame:
    """All rows of the labelers' tables, repeated ones included; tables of another shape are an error."""
    first, *others = tables
    shape = {f.name: f.dataType for f in first.schema}
    for n, other in enumerate(others, 2):
        if {f.name: f.dataType for f in other.schema} != shape:
            raise ValueError(f"table {n} has the columns {other.schema.simpleString()}, the first {first.schema.simpleString()}")
        first = first.unionByName(other)
    return first


def relaxed_union(tables: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a table lacks is null there, and number types widen."""
    out, *others = tables
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def label_tables(tasks: DataFrame, meta: DataFrame, num_frames: int = NUM_FRAMES) -> tuple[DataFrame, DataFrame]:
    """``(videos, tracks)`` of annotation tasks.

    ``meta`` holds ``camera_id, video_id, true_fps, frame_count`` of the containers. Videos get the container's frame
    count; tracks are rolled up, rescaled, and buffered to ``num_frames`` frames within their video. Videos come from the tasks
    alone and meet their frame counts first, so tracks are moved once.
    """
    keep = annotated(tasks)
    videos = videos_of(task_videos(keep), meta)
    tracks = extend_single_keyframes(track_rollup(keyframes(flatten_results(keep)), ("labeler", "video_idx", "track_id"))).drop("frames_count")
    # of videos with one name, a track meets each one's frame count
    named = F.collect_list(F.struct(F.col("frame_count").alias("_count"))).over(Window.partitionBy(*KEY))
    unknown = F.array(F.struct(F.lit(None).cast("bigint").alias("_count")))
    ids = videos.select("labeler", "video_idx", *KEY, "ls_fps", "true_fps", named.alias("_counts"))
    known = F.col("camera_id").isNotNull() & F.col("video_id").isNotNull()
    ids = ids.select("labeler", "video_idx", *KEY, "ls_fps", "true_fps", F.inline(F.when(known, F.col("_counts")).otherwise(unknown)))
    tracks = rescale_frames(tracks.join(ids, ["labeler", "video_idx"], "left")).drop("ls_fps", "labeler", "video_idx")
    tracks = buffer_counted(truncate_rests(tracks, num_frames), num_frames)
    videos = videos.select(
        "video_path", F.col("frame_count").alias("frames_count"), "duration", "camera_id", "video_id", "video_ext", "true_fps")
    return videos, tracks.select(*KEY, *(c for c in tracks.columns if c not in KEY))
