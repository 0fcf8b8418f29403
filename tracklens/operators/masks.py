"""Masks as runs: geometry, segments, cage assignment.

A mask is a set of runs ``y, x0, x1`` (inclusive) and a row in a table of objects, which also knows masks without a
single pixel. Joins are on keys and ``y``; only the overlap of two runs is a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.numbers import clipped, ratio, truncated

VIDEO = ["camera_id", "video_id"]
#: Tasks that points of one pixel row or chunk are dealt over.
DEALS = 8


def row_runs(row: Column) -> Column:
    """The maximal runs of true cells in a boolean array, as ``x0, x1``."""
    at = F.sequence(F.lit(0), F.size(row) - 1)
    on = lambda x: F.coalesce(F.get(row, x), F.lit(False))
    starts = F.filter(at, lambda x: on(x) & ~F.coalesce(F.get(row, x - 1), F.lit(False)))
    ends = F.filter(at, lambda x: on(x) & ~F.coalesce(F.get(row, x + 1), F.lit(False)))
    return F.when(F.size(row) > 0, F.arrays_zip(starts.alias("x0"), ends.alias("x1")))


def mask_runs(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """One row per run of each mask, given as nested boolean lists; other columns are kept."""
    rest = [c for c in masks.columns if c != mask]
    rows = masks.select(*rest, F.posexplode(mask).alias("y", "_row"))
    runs = rows.select(*rest, "y", F.explode(row_runs(F.col("_row"))).alias("_r"))
    return runs.select(*rest, "y", F.col("_r.x0").alias("x0"), F.col("_r.x1").alias("x1"))


def mask_area_array(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda n, row: n + F.size(F.filter(row, lambda v: v)))


def mask_areas(objects: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, area`` of every object, 0 for empty masks."""
    areas = runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return objects.select(*keys).distinct().join(areas, keys, "left").withColumn("area", F.coalesce("area", F.lit(0)).cast("bigint"))


def mask_intersections(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Common pixels of the masks of two run tables that agree in ``keys``."""
    right = b.select(*keys, "y", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    overlap = F.least("x1", "bx1") - F.greatest("x0", "bx0") + 1
    return a.select(*keys, "y", "x0", "x1").join(right, [*keys, "y"]).filter("x0 <= bx1 and bx0 <= x1").groupBy(*keys).agg(
        F.sum(overlap).alias("common"))


def mask_iou(objects_a: DataFrame, runs_a: DataFrame, objects_b: DataFrame, runs_b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, common, united, iou`` of objects in both tables; null where both masks are empty."""
    area_a = mask_areas(objects_a, runs_a, keys).withColumnRenamed("area", "area_a")
    area_b = mask_areas(objects_b, runs_b, keys).withColumnRenamed("area", "area_b")
    both = area_a.join(area_b, keys).join(mask_intersections(runs_a, runs_b, keys), keys, "left")
    both = both.withColumn("common", F.coalesce("common", F.lit(0)).cast("bigint")).withColumn(
        "united", F.col("area_a") + F.col("area_b") - F.col("common"))
    return both.select(*keys, "common", "united", ratio(F.col("common"), F.col("united")).alias("iou"))


def mask_iou_arrays(a: Column, b: Column) -> Column:
    """The same for two small masks in array form."""
    both = F.aggregate(F.zip_with(a, b, lambda p, q: F.size(F.filter(F.zip_with(p, q, lambda x, y: x & y), lambda v: v))), F.lit(0), lambda n, x: n + x)
    return ratio(both, mask_area_array(a) + mask_area_array(b) - both)


def mask_boxes(runs: DataFrame, keys: list[str], height: int | str, width: int | str, padding: int = 0) -> DataFrame:
    """The padded bounding box of every mask, held inside the image; empty masks have none."""
    h = F.lit(height) if isinstance(height, int) else F.max(height)
    w = F.lit(width) if isinstance(width, int) else F.max(width)
    return runs.groupBy(*keys).agg(
        F.greatest(F.lit(0), F.min("x0") - padding).cast("bigint").alias("x_min"),
        F.greatest(F.lit(0), F.min("y") - padding).cast("bigint").alias("y_min"),
        F.least(w - 1, F.max("x1") + padding).cast("bigint").alias("x_max"),
        F.least(h - 1, F.max("y") + padding).cast("bigint").alias("y_max"))


def previous_frames(objects: DataFrame, by: list[str]) -> DataFrame:
    """``by, frame, prev_frame`` over the frames that have objects."""
    frames = objects.select(*by, "frame").distinct()
    return frames.withColumn("prev_frame", F.lag("frame").over(Window.partitionBy(*by).orderBy("frame")))


def frame_ious(objects: DataFrame, runs: DataFrame, by: list[str], obj: str = "cage_id") -> DataFrame:
    """The overlap of every object with itself in the frame before: ``by, frame, obj, common, united, iou``."""
    pairs = previous_frames(objects, by)
    later = pairs.select(*by, F.col("frame").alias("_next"), F.col("prev_frame").alias("frame")).filter("frame is not null")
    shift = lambda df: df.join(later, [*by, "frame"]).drop("frame").withColumnRenamed("_next", "frame")
    return mask_iou(objects, runs, shift(objects), shift(runs), [*by, "frame", obj])


def segment_boundaries(objects: DataFrame, runs: DataFrame, by: list[str], threshold: float = 0.90, obj: str = "cage_id") -> DataFrame:
    """``by, frame, min_iou, is_start`` per frame: the first frame, frames that share no object with the frame before,
    and frames whose smallest overlap is below ``threshold`` start a segment. An overlap of two empty masks is no evidence."""
    ious = frame_ious(objects, runs, by, obj).groupBy(*by, "frame").agg(F.min("iou").alias("min_iou"), F.count("*").alias("n_common"))
    rows = previous_frames(objects, by).join(ious, [*by, "frame"], "left")
    starts = F.col("prev_frame").isNull() | F.col("n_common").isNull() | F.coalesce(F.col("min_iou") < threshold, F.lit(False))
    return rows.select(*by, "frame", "min_iou", starts.alias("is_start"))


def segments_of(boundaries: DataFrame, by: list[str]) -> DataFrame:
    """``by, segment_idx, start, end``: a segment ends before the next one starts, the last at the last frame."""
    w = Window.partitionBy(*by).orderBy("frame")
    last = boundaries.groupBy(*by).agg(F.max("frame").alias("_last"))
    starts = boundaries.filter("is_start").select(
        *by, (F.row_number().over(w) - 1).cast("bigint").alias("segment_idx"), F.col("frame").alias("start"),
        F.lead("frame").over(w).alias("_next"))
    return starts.join(last, by).select(*by, "segment_idx", "start", F.coalesce(F.col("_next") - 1, F.col("_last")).alias("end"))


def keyframe_masks(runs: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """The runs of each segment's first frame, with ``segment_idx`` in place of the frame."""
    first = segments.select(*by, "segment_idx", F.col("start").alias("frame"))
    return runs.join(first, [*by, "frame"]).drop("frame")


def renumbered(frames: DataFrame, by: list[str]) -> DataFrame:
    """Drops the seeding frame (the first) and numbers the others from 0."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("frame")) - 2
    return frames.withColumn("ordinal", n).filter("ordinal >= 0")


def segment_lookup(frames: DataFrame, segments: DataFrame, by: list[str], offset: int = 0) -> DataFrame:
    """Adds ``segment_idx``: the first segment that holds the frame, else the video's highest one.

    Segments are ordered and do not overlap, so the one with the greatest start not after the frame is the only
    candidate: starts and frames are merged in one sorted pass per video instead of a range join. Videos without segments
    drop out.
    """
    key = [F.col(c) for c in by]
    last = segments.groupBy(*by).agg(F.max("segment_idx").alias("_highest"))
    marks = segments.select(*key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("segment_idx", "end").alias("_seg"))
    asked = frames.select(*by, "frame").distinct().select(
        *key, (F.col("frame") + offset).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_seg"].dataType).alias("_seg"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = marks.unionByName(asked).withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).filter("_kind = 1")
    hit = hit.join(last, by).select(
        *by, (F.col("_at") - offset).alias("frame"),
        F.when(F.col("_at") <= F.col("_seg.end"), F.col("_seg.segment_idx")).otherwise(F.col("_highest")).alias("segment_idx"))
    return frames.join(hit, [*by, "frame"])


def point_cell(x: Column, y: Column, height, width) -> tuple[Column, Column]:
    """The pixel of a normalised point, held inside the image."""
    cy = truncated(clipped(y * height, 0.0, float(height - 1) if isinstance(height, int) else (height - 1).cast("double")))
    cx = truncated(clipped(x * width, 0.0, float(width - 1) if isinstance(width, int) else (width - 1).cast("double")))
    return cx, cy


def dealt(points: DataFrame, columns: list[str]) -> DataFrame:
    """Points with ``_deal``, so that those of one key are not all one task's; see :func:`copied`."""
    return points.withColumn("_deal", F.pmod(F.xxhash64(*columns), F.lit(DEALS)).cast("int"))


def copied(rows: DataFrame) -> DataFrame:
    """What the points of each ``_deal`` meet: few rows beside the points, once for each."""
    return rows.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))


def cages_of_points(points: DataFrame, runs: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Adds ``cage_id``: of the masks that hold a point, the first in mask order; null without one."""
    cx, cy = point_cell(F.col("mean_x"), F.col("mean_y"), height, width)
    cells = points.withColumns({"_cx": cx, "_cy": cy})
    # one row per pixel row of a segment, as wide as its masks: points meet it once and are not multiplied
    rows = runs.groupBy(*keys, F.col("y").cast("bigint").alias("_cy")).agg(
        F.array_sort(F.collect_list(F.struct("cage_ord", "x0", "x1", "cage_id"))).alias("_runs"))
    hit = F.get(F.filter("_runs", lambda r: (r["x0"] <= F.col("_cx")) & (F.col("_cx") <= r["x1"])), F.lit(0))
    met = dealt(cells, points.columns).join(copied(rows), [*keys, "_cy", "_deal"], "left")
    return met.withColumn("cage_id", hit["cage_id"]).drop("_cx", "_cy", "_runs", "_deal")


def assign_cages(index: DataFrame, segments: DataFrame, runs: DataFrame, height: int, width: int, by: list[str] = VIDEO) -> DataFrame:
    """The cage of each track, from its mean point and the masks at the video's first annotated frame.

    ``runs`` carry ``segment_idx``. Tracks in no cage drop out.
    """
    first = index.groupBy(*by).agg(F.min("frame_begin").alias("frame"))
    at = segment_lookup(first, segments, by).drop("frame")
    # the masks take the segment's video, so tracks meet them at once by video and pixel row and are not gathered by video alone
    return cages_of_points(index, runs.join(at, [*by, "segment_idx"]), by, height, width).filter("cage_id is not null")


def plan_crops(crops: DataFrame, segments: DataFrame, boxes: DataFrame, existing: DataFrame | None = None, by: list[str] = VIDEO) -> DataFrame:
    """Every crop with its mask's box; frames without that cage's mask, and crops that exist, are left out.

    ``crops`` holds distinct ``by, cage_id, frame``; ``boxes`` one row per ``by, segment_idx, cage_id``.
    """
    rows = segment_lookup(crops, segments, by).join(boxes, [*by, "segment_idx", "cage_id"])
    return rows if existing is None else rows.join(existing.select(*by, "cage_id", "frame").distinct(), [*by, "cage_id", "frame"], "left_anti")


def plan_all_cages(guidance: DataFrame, segments: DataFrame, boxes: DataFrame, by: list[str] = VIDEO) -> DataFrame:
    """Every target frame times every cage of its segment."""
    frames = guidance.select(*by, F.explode("target_frames").alias("frame"))
    return segment_lookup(frames, segments, by).join(boxes, [*by, "segment_idx"])


def with_runs(plan: DataFrame, runs: DataFrame, by: list[str] = VIDEO) -> DataFrame:
    """Planned crops with their mask's runs, in rows and columns."""
    own = [*by, "segment_idx", "cage_id"]
    masks = runs.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    return plan.join(masks, own)


def crop_jobs(plan: DataFrame, runs: DataFrame, images: DataFrame, by: list[str] = VIDEO) -> DataFrame:
    """Planned crops with their image and their mask's runs, the input of :func:`tracklens.operators.images.crop_images_mask`.

    ``images`` holds ``by, frame`` and the image columns. ``origin`` becomes the crop's name, ``{image}_cage_{cage}``. An image is copied for each
    of its crops; :func:`tracklens.operators.images.cut_images` moves it once.
    """
    rows = with_runs(plan, runs, by).join(images, [*by, "frame"])
    return rows.withColumn("origin", F.concat("origin", F.lit("_cage_"), "cage_id"))
