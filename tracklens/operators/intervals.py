"""Frame-interval operators: buffering, expansion, sampling, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.draws import permuted
from tracklens.functions.numbers import frames_between, half_even, seeded_order

KEY = ["camera_id", "video_id"]


def buffer_tracks(tracks: DataFrame, videos: DataFrame, num_frames: int, strict: bool = False) -> DataFrame:
    """Lengthens short tracks on both sides to ``num_frames`` frames inside their video.

    What reaches over one end is added at the other, both computed before either is clamped to
    ``[1, frames_count]``. A begin of exactly 0 is not counted as reaching over, which leaves such a track one frame
    short; ``strict`` counts it. Tracks of unknown videos stay unclamped at the end.
    """
    counts = videos.select(*KEY, F.col("frames_count").alias("_count"))
    return buffer_counted(tracks.join(counts, KEY, "left"), num_frames, strict)


def buffer_counted(tracks: DataFrame, num_frames: int, strict: bool = False) -> DataFrame:
    """As :func:`buffer_tracks`, for tracks that have met the frame count of their video (``_count``)."""
    begin, end, count = F.col("frame_begin"), F.col("frame_end"), F.col("_count")
    length = end - begin + 1
    grow = F.when(length < num_frames, F.expr(f"({num_frames} - (frame_end - frame_begin + 1) + 1) div 2")).otherwise(0)
    rows = tracks.withColumn("_grow", grow).withColumns({"frame_begin": begin - F.col("_grow"), "frame_end": end + F.col("_grow")})
    early = F.when(begin < 1, 1 - begin).otherwise(0) if strict else F.when(begin < 0, F.abs(begin) + 1).otherwise(0)
    rows = rows.withColumns({"_add": early, "_sub": F.when(end > count, end - count).otherwise(0)})
    return rows.withColumns({
        "frame_begin": F.greatest(F.lit(1).cast("bigint"), begin - F.col("_sub")),
        "frame_end": F.least(count, end + F.col("_add")),
    }).drop("_grow", "_count", "_add", "_sub")


def expand_frames(tracks: DataFrame, begin: str = "frame_begin", end: str = "frame_end") -> DataFrame:
    """One row per frame of every interval; an interval that ends before it begins has none."""
    return tracks.withColumn("frame", F.explode(frames_between(F.col(begin), F.col(end))))


def all_frames(videos: DataFrame) -> DataFrame:
    """``target_frames`` of whole videos, from 1 to the frame count."""
    return videos.withColumn("target_frames", frames_between(F.lit(1), F.col("frames_count")))


def label_counts(tracks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Frames of each label in each video, overlapping tracks counted each; nothing is expanded."""
    return tracks.groupBy(*keys, "label").agg(
        F.sum(F.greatest(F.lit(0).cast("bigint"), F.col("frame_end") - F.col("frame_begin") + 1)).alias("n_frames"))


def pivot_label_counts(tracks: DataFrame, labels: list[str], keys: list[str] = KEY) -> DataFrame:
    """One column per label, 0 where a video does not have it."""
    return label_counts(tracks, keys).groupBy(*keys).pivot("label", labels).sum("n_frames").fillna(0)


def _island_rows(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint covered stretches of each video, so that each frame is made once and none is deduplicated.

    Tracks that begin together are merged before they are shuffled, so the window holds a video's begins, not its tracks.
    """
    w = Window.partitionBy(*keys).orderBy("frame_begin").rowsBetween(Window.unboundedPreceding, -1)
    begins = tracks.filter("frame_end >= frame_begin").groupBy(*keys, "frame_begin").agg(F.max("frame_end").alias("frame_end"))
    rows = begins.withColumn("_reach", F.max("frame_end").over(w))
    fresh = F.greatest(F.col("frame_begin"), F.coalesce(F.col("_reach") + 1, F.col("frame_begin")))
    return rows.select(*keys, fresh.alias("first"), F.col("frame_end").alias("last")).filter("last >= first")


def target_frames(tracks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The sorted distinct frames that any track of a video covers."""
    stretches = _island_rows(tracks, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("s"))
    frames = F.flatten(F.transform("s", lambda x: F.sequence(x["first"], x["last"])))
    return stretches.select(*keys, frames.alias("target_frames"))


def subsample_frames(tracks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``target_frames``, ``label_counts`` (label -> frames, 0 for labels seen elsewhere only) and ``frames_count`` per video."""
    known = tracks.agg(F.sort_array(F.collect_set("label"))).scalar()  # each label name once
    counts = label_counts(tracks, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "n_frames"))).alias("own"))
    counts = counts.withColumn("known", known).select(
        *keys, F.map_from_entries(F.transform("known", lambda n: F.struct(
            n, F.coalesce(F.element_at(F.col("own"), n), F.lit(0).cast("bigint"))))).alias("label_counts"))
    totals = tracks.groupBy(*keys).agg(F.min("frames_count").alias("frames_count"))
    return target_frames(tracks, keys).join(counts, keys).join(totals, keys, "left")


def sample_rest_frames(guidance: DataFrame, seed: int, keys: list[str] = KEY) -> DataFrame:
    """Adds as many uncovered frames as the most frequent label has, or as there are.

    Drawn without replacement in md5 order of seed, video and frame, and appended, so the list is not sorted;
    ``added_rests`` is their number.
    """
    candidates = F.array_except(frames_between(F.lit(1), F.col("frames_count")), F.col("target_frames"))
    most = F.array_max(F.map_values("label_counts"))
    remaining = F.col("frames_count") - F.size("target_frames")
    rows = guidance.withColumn("_candidates", candidates)
    wanted = F.when(most > remaining, remaining).otherwise(F.least(most, F.size("_candidates")))
    ordered = F.transform(
        F.array_sort(F.transform("_candidates", lambda f: F.struct(
            seeded_order(seed, *(F.col(k) for k in keys), f).alias("h"), f.alias("f")))),
        lambda x: x["f"])
    rows = rows.withColumn("added_rests", wanted.cast("bigint")).withColumn(
        "_drawn", F.slice(ordered, F.lit(1), F.greatest(F.lit(0), F.col("added_rests")).cast("int")))
    return rows.withColumn("target_frames", F.concat("target_frames", "_drawn")).drop("_candidates", "_drawn", "frames_count")


def random_frames(videos: DataFrame, n: int, seed: int, keys: list[str] = KEY) -> DataFrame:
    """``n`` frames of every video without replacement, sorted; an error where a video has fewer."""
    frames = frames_between(F.lit(1), F.col("frames_count"))
    ordered = F.array_sort(F.transform(frames, lambda f: F.struct(
        seeded_order(seed, *(F.col(k) for k in keys), f).alias("h"), f.alias("f"))))
    drawn = F.array_sort(F.transform(F.slice(ordered, 1, n), lambda x: x["f"]))
    checked = F.when(F.col("frames_count") >= n, drawn).otherwise(
        F.raise_error(F.lit("fewer frames than asked for")).cast("array<bigint>"))
    return videos.select(*keys, checked.alias("frames"))


def _draw_key(seed: int, keys: list[str]) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))


def draw_frames(videos: DataFrame, n: int, seed: int, keys: list[str] = KEY) -> DataFrame:
    """As :func:`random_frames`, ``n`` rows ``keys, draw, frame`` a video, by a keyed permutation of its frames: the work is in proportion to
    ``n``, however long the video is. An error where a video has fewer."""
    if n == 0:
        return videos.select(*keys, F.lit(0).cast("bigint").alias("draw"), F.lit(0).cast("bigint").alias("frame")).limit(0)
    last = F.when(F.col("frames_count") >= n, n - 1).otherwise(F.raise_error(F.lit("fewer frames than asked for")).cast("int")).cast("bigint")
    rows = videos.select(*keys, "frames_count", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("draw"))
    return rows.select(*keys, "draw", (permuted(F.col("draw"), F.col("frames_count"), _draw_key(seed, keys)) + 1).alias("frame"))


def draw_rests(tracks: DataFrame, videos: DataFrame, seed: int, keys: list[str] = KEY) -> DataFrame:
    """``keys, frame`` of as many frames that no track covers as a video's most frequent label has, or as there are.

    The uncovered frames are known by the gaps between covered stretches: a draw is a rank among them, and the gap that holds the rank gives the
    frame. No row holds a video's frames. Videos without tracks draw none.
    """
    stretches = _island_rows(tracks, keys).join(videos.select(*keys, "frames_count"), keys).filter("first <= frames_count and last >= 1")
    by_video = Window.partitionBy(*keys).orderBy("first")
    ends = F.coalesce(F.lead("first").over(by_video), F.col("frames_count") + 1)
    after = stretches.select(*keys, "frames_count", (F.col("last") + 1).alias("low"), ends.alias("high"))
    starts = stretches.groupBy(*keys).agg(F.min("frames_count").alias("frames_count"), F.lit(1).cast("bigint").alias("low"), F.min("first").alias("high"))
    gaps = after.unionByName(starts).filter("high > low")
    # ranks before each gap, and of the whole video
    order = Window.partitionBy(*keys).orderBy("low")
    size = F.col("high") - F.col("low")
    gaps = gaps.withColumns({
        "_before": F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_free": F.sum(size).over(Window.partitionBy(*keys))})
    most = label_counts(tracks, keys).groupBy(*keys).agg(F.max("n_frames").alias("_most"))
    asked = gaps.groupBy(*keys).agg(F.max("_free").alias("_free")).join(most, keys)
    draws = asked.filter("least(_most, _free) > 0").select(*keys, "_free", F.explode(F.expr("sequence(0L, least(_most, _free) - 1)")).alias("draw"))
    ranks = draws.select(*keys, permuted(F.col("draw"), F.col("_free"), _draw_key(seed, keys)).alias("_rank"))
    # a rank's gap is the last one that begins at it or before: gaps and ranks merge in one sorted pass
    marks = gaps.select(*keys, F.col("_before").alias("_at"), F.lit(0).alias("_kind"), (F.col("low") - F.col("_before")).alias("_shift")).unionByName(
        ranks.select(*keys, F.col("_rank").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_shift")))
    merged = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("_shift", F.last("_shift", ignorenulls=True).over(merged)).filter("_kind = 1")
    return found.select(*keys, (F.col("_at") + F.col("_shift")).alias("frame"))


def interpolate_keyframes(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Fills the frames between keyframes linearly; the last keyframe of a track appears once."""
    w = Window.partitionBy(*keys).orderBy("frame")
    values = ["x", "y", "width", "height"]
    rows = frames.withColumns({f"_next_{c}": F.lead(c).over(w) for c in ["frame", *values]})
    until = F.coalesce(F.col("_next_frame") - 1, F.col("frame"))
    rows = rows.withColumn("_at", F.explode(frames_between(F.col("frame"), until)))
    share = (F.col("_at") - F.col("frame")).cast("double") / (F.col("_next_frame") - F.col("frame"))
    blended = {c: F.when(F.col("_at") == F.col("frame"), F.col(c)).otherwise(F.col(c) + (F.col(f"_next_{c}") - F.col(c)) * share) for c in values}
    return rows.select(*keys, F.col("_at").alias("frame"), *(blended[c].alias(c) for c in values))


def smooth_centers(
    frames: DataFrame, keys: list[str], xc: str = "xc", yc: str = "yc", width: int = 5, line: str | None = None
) -> DataFrame:
    """Centred moving average over at most ``width`` frames, with zeros beyond both ends.

    The denominator is always ``k = min(width, n)``; a lone frame keeps its centre. With ``line``, a frame may hold
    several boxes, numbered by that column: only the first counts, and the centre made from it goes to all of them.
    """
    if line is not None:
        firsts = frames.groupBy(*keys, "frame").agg(F.min_by(xc, line).alias(xc), F.min_by(yc, line).alias(yc))
        smooth = smooth_centers(firsts, keys, xc, yc, width).drop(xc, yc)
        # a lone frame keeps the centre of each of its boxes
        alone = F.count("*").over(Window.partitionBy(*keys)) == 1
        smooth = smooth.withColumn("_alone", alone)
        rows = frames.join(smooth, [*keys, "frame"])
        return rows.withColumns({
            f"smooth_{c}": F.when(F.col("_alone"), F.col(c)).otherwise(F.col(f"smooth_{c}")) for c in (xc, yc)}).drop("_alone")
    order = Window.partitionBy(*keys).orderBy("frame")
    n = F.count("*").over(Window.partitionBy(*keys))
    out = {}
    for c in (xc, yc):
        smooth: Column = F.col(c)
        for k in range(2, width + 1):
            high = (k - 1) // 2
            total = F.sum(c).over(order.rowsBetween(high - k + 1, high)) / float(k)
            smooth = F.when((n >= k) if k == width else (n == k), total).otherwise(smooth)
        out[f"smooth_{c}"] = smooth
    return frames.withColumns(out)


def camera_splits(videos: DataFrame, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """``camera_id, split``: cameras in md5 order, the first part ``train``, the next ``val``, the rest ``test``.

    Part sizes round half to even. The table has a row per camera, so one window over it is small.
    """
    cameras = videos.select("camera_id").distinct()
    place = F.row_number().over(Window.orderBy(seeded_order(seed, F.col("camera_id")), "camera_id"))
    n = F.count("*").over(Window.partitionBy())
    rows = cameras.select("camera_id", place.alias("k"), n.alias("n"))
    n_train, n_val = half_even(F.lit(ratios[0]) * F.col("n")), half_even(F.lit(ratios[1]) * F.col("n"))
    split = F.when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + n_val, "val").otherwise("test")
    return rows.select("camera_id", split.alias("split"))
