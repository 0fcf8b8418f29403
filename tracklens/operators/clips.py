"""Clip index and sliding clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.paths import label_folder
from tracklens.operators.intervals import KEY, _island_rows, expand_frames


def clip_index(tracks: DataFrame, videos: DataFrame, guidance: DataFrame) -> DataFrame:
    """Tracks with their split, by video and then by video path."""
    paths = videos.select(*KEY, "video_path")
    splits = guidance.select("video_path", "split")
    means = [c for c in ("mean_x", "mean_y", "mean_width", "mean_height") if c in tracks.columns]
    return tracks.join(paths, KEY).join(splits, "video_path").select(
        "track_id", *KEY, "label", "frame_begin", "frame_end", "split", *means)


def track_frames(index: DataFrame, frames: DataFrame) -> DataFrame:
    """The available frames of each track: same camera, video and cage, inside its interval.

    Intervals are expanded and joined on the frame as well, so the join is an equi-join whose keys spread.
    """
    keys = [k for k in (*KEY, "cage_id") if k in index.columns and k in frames.columns]
    return expand_frames(index).join(frames.select(*keys, "frame").distinct(), [*keys, "frame"])


def sliding_clips(rows: DataFrame, keys: list[str], num_frames: int = 16, stride: int = 8) -> DataFrame:
    """``clip_idx, pos`` of every frame in every full clip over the frames present, in order.

    Clips start at 0, stride, 2 stride, ... of a track's frames, whatever gaps these have; a short rest makes no clip.
    """
    by_track = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "_rn": F.row_number().over(by_track.orderBy("frame")) - 1, "_n": F.count("*").over(by_track)}).filter(F.col("_n") >= num_frames)
    first = F.ceil(F.greatest(F.lit(0), F.col("_rn") - num_frames + 1) / stride).cast("bigint")
    last = F.expr(f"least(_rn div {stride}, (_n - {num_frames}) div {stride})")
    clips = F.when(last >= first, F.sequence(first, last))
    return rows.withColumn("clip_idx", F.explode(clips)).withColumn(
        "pos", F.col("_rn") - F.col("clip_idx") * stride).drop("_rn", "_n")


def bucketed_clip_index(tracks: DataFrame, videos: DataFrame, guidance: DataFrame) -> DataFrame:
    """:func:`clip_index` of tables in buckets by camera and video (:func:`tracklens.sources.sinks.write_bucketed`): both joins are on these keys and
    shuffle nothing. ``guidance`` carries them beside ``video_path``, which has to agree as well."""
    paths = videos.select(*KEY, "video_path")
    splits = guidance.select(*KEY, F.col("video_path").alias("_path"), "split")
    means = [c for c in ("mean_x", "mean_y", "mean_width", "mean_height") if c in tracks.columns]
    # written as an equality it would become a join key, which the buckets do not have
    same = "instr(video_path, _path) = 1 and instr(_path, video_path) = 1"
    rows = tracks.join(paths.hint("merge"), KEY).join(splits.hint("merge"), KEY).filter(same)
    return rows.select("track_id", *KEY, "label", "frame_begin", "frame_end", "split", *means)


def frame_blocks(frames: DataFrame, keys: list[str], span: int) -> DataFrame:
    """The rank index of the distinct frames of each video (and cage): ``keys, block, frames, base`` with the sorted frames of every stretch
    of ``span`` frame numbers that has any, and the number of frames before it."""
    blocks = frames.groupBy(*keys, F.floor(F.col("frame") / span).alias("block")).agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    before = F.sum(F.size("frames")).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("base", F.coalesce(before, F.lit(0)).cast("bigint"))


def _held_frames(index: DataFrame, frames: DataFrame, keys: list[str], span: int) -> DataFrame:
    """The index's rows by the blocks they reach: ``held`` frames of theirs in one block, ``at`` as the rank of the first of these among all of
    the row's frames, and ``n`` of these.

    A row meets its blocks by an equi-join; nothing is expanded to frames. Ranks follow from the blocks' bases; only rows that reach over a
    block's end need their own blocks together.
    """
    blocks = frame_blocks(frames, keys, span)
    first, last = (F.floor(F.col(c) / span) for c in ("frame_begin", "frame_end"))
    rows = index.filter("frame_end >= frame_begin").withColumns({"_first": first, "_last": last})

    def met(some: DataFrame) -> DataFrame:
        both = some.join(blocks, [*keys, "block"])
        held = F.filter("frames", lambda f: (f >= F.col("frame_begin")) & (f <= F.col("frame_end")))
        low = F.col("base") + F.size(F.filter("frames", lambda f: f < F.col("frame_begin")))
        return both.withColumns({"held": held, "_low": low}).filter(F.size("held") > 0).drop("frames", "base", "block", "_first", "_last")

    one = met(rows.filter("_first = _last").withColumn("block", F.col("_first")))
    one = one.withColumns({"at": F.lit(0).cast("bigint"), "n": F.size("held").cast("bigint"), "_copies": F.lit(1).cast("bigint")})
    many = rows.filter("_first < _last").groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    many = met(many.withColumn("block", F.explode(F.sequence("_first", "_last"))))
    own = Window.partitionBy(*index.columns)
    many = many.withColumns({"at": F.col("_low") - F.min("_low").over(own), "n": F.sum(F.size("held")).over(own)})
    both = one.unionByName(many).drop("_low")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copy", "_copies")


def behavior_clips(
    index: DataFrame, frames: DataFrame, num_frames: int = 16, stride: int = 8, strict: bool = False, span: int = 256
) -> DataFrame:
    """``split, label, track_id, cage_id, clip_idx, pos, frame`` of all clips, labels as folder names.

    Clips run over the frames present in a track's interval, by their ranks (:func:`_held_frames`): from a track's number of frames follows how
    many clips it has, from a frame's rank in which of them it is. Shuffled are the frames, once, and a row per track and block of ``span`` frames.

    Tracks without a frame are left out. Those with some but fewer than ``num_frames`` make no clip either
    (:func:`short_tracks` lists them); with ``strict`` the job fails on them.
    """
    cage = ["cage_id"] if "cage_id" in index.columns else []
    keys = [k for k in (*KEY, "cage_id") if k in index.columns and k in frames.columns]
    rows = _held_frames(index.select("split", "label", *KEY, *cage, "track_id", "frame_begin", "frame_end"), frames, keys, span)
    if strict:
        told = F.concat(F.lit("fewer frames than a clip has: track "), F.col("track_id"))
        rows = rows.filter(F.when(F.col("n") < num_frames, F.raise_error(told).cast("boolean")).otherwise(True))
    rows = rows.filter(F.col("n") >= num_frames).withColumn("_last", F.expr(f"(n - {num_frames}) div {stride}"))
    shown = rows.select("split", "label", "track_id", *cage, "_last", "at", F.posexplode("held").alias("_i", "frame"))
    shown = shown.withColumn("_rn", F.col("at") + F.col("_i"))
    first = F.ceil(F.greatest(F.lit(0), F.col("_rn") - num_frames + 1) / stride).cast("bigint")
    last = F.least(F.expr(f"_rn div {stride}"), F.col("_last"))
    clips = shown.withColumn("clip_idx", F.explode(F.when(last >= first, F.sequence(first, last))))
    return clips.select(
        "split", label_folder(F.col("label")).alias("label"), "track_id", *cage, "clip_idx", (F.col("_rn") - F.col("clip_idx") * stride).alias("pos"), "frame")


def short_tracks(index: DataFrame, frames: DataFrame, num_frames: int = 16, span: int = 256) -> DataFrame:
    """Tracks with some frames but too few for a clip: an error in the data, listed here."""
    keys = [k for k in (*KEY, "cage_id") if k in index.columns and k in frames.columns]
    rows = index.select(*dict.fromkeys([*KEY, *keys, "track_id", "frame_begin", "frame_end"]))
    # the block of a row's first frame tells its number of frames
    return _held_frames(rows, frames, keys, span).filter((F.col("at") == 0) & (F.col("n") < num_frames)).select(*KEY, "track_id", "n")


def crop_list(index: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The distinct crops to make: camera, video, cage and frame, with the video's split."""
    keys = keys or [*KEY, "cage_id"]
    frames = expand_frames(_island_rows(index, keys), "first", "last").select(*keys, "frame")
    return frames.join(index.groupBy(*keys).agg(F.min("split").alias("split")), keys)
