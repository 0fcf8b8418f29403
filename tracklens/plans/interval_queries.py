"""Queries of the label, interval, split and clip operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions import paths
from tracklens.functions.numbers import frames_between, ratio
from tracklens.operators import clips, evaluation, filters, intervals, labels, lookups, split
from tracklens.plans.adapters import TASK_KEYS, adapter, oracle, table
from tracklens.sources.sinks import missing_only

RATIOS, SEED, LABELS = (0.70, 0.15, 0.15), 42, ["Foraging", "Preening", "Resting"]
VIDEO = ["camera_id", "video_id"]

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str, *views: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


def text_of(frames: str = "target_frames"):
    return F.array_join(F.transform(frames, lambda f: f.cast("string")), ",").alias(frames)


def tracks_with_counts(spark, d) -> DataFrame:
    return adapter(spark, d, "a2").join(adapter(spark, d, "a1").select(*VIDEO, "frames_count"), VIDEO)


@query("track_rollup", """
    SELECT track_id, min(frame) + 1 AS frame_begin,
           CASE WHEN min(frame) = max(frame) THEN 100 ELSE max(frame) + 1 END AS frame_end,
           avg(x) AS mean_x, avg(y) AS mean_y, avg(width) AS mean_width, avg(height) AS mean_height
    FROM a3 GROUP BY track_id""", "a3")
def track_rollup(spark, d):
    frames = adapter(spark, d, "a3").withColumn("frames_count", F.lit(100).cast("bigint"))
    return labels.extend_single_keyframes(labels.track_rollup(frames)).drop("frames_count")


@query("fps_rescale", """
    SELECT track_id, label, video_id, CAST(trunc(frame_begin * (true_fps / (frames_count / duration))) AS BIGINT) AS frame_begin,
           CAST(trunc(frame_end * (true_fps / (frames_count / duration))) AS BIGINT) AS frame_end
    FROM a2 JOIN a1 USING (camera_id, video_id)""", "a1", "a2")
def fps_rescale(spark, d):
    videos = adapter(spark, d, "a1").withColumn("ls_fps", ratio(F.col("frames_count"), F.col("duration")))
    rows = adapter(spark, d, "a2").join(videos, VIDEO)
    return labels.rescale_frames(rows).select("track_id", "label", "video_id", "frame_begin", "frame_end")


_BUFFERED = """
    rest AS (SELECT track_id, label, camera_id, video_id, frame_begin AS b,
                    CASE WHEN label = 'Resting' THEN frame_begin + 15 ELSE frame_end END AS e FROM a2),
    grown AS (SELECT *, CASE WHEN e - b + 1 < 16 THEN (16 - (e - b + 1) + 1) // 2 ELSE 0 END AS g FROM rest),
    moved AS (SELECT g.*, b - g AS nb, e + g AS ne, frames_count AS n FROM grown g LEFT JOIN a1 USING (camera_id, video_id))"""


@query("buffer_tracks", _BUFFERED + """
    SELECT track_id, label, camera_id, video_id,
           CAST(greatest(1, nb - CASE WHEN ne > n THEN ne - n ELSE 0 END) AS BIGINT) AS frame_begin,
           CAST(least(n, ne + CASE WHEN nb < 0 THEN abs(nb) + 1 ELSE 0 END) AS BIGINT) AS frame_end
    FROM moved""", "a1", "a2")
def buffer_tracks(spark, d):
    tracks = labels.truncate_rests(adapter(spark, d, "a2"))
    return intervals.buffer_tracks(tracks, adapter(spark, d, "a1"), 16).select("track_id", "label", *VIDEO, "frame_begin", "frame_end")


_SUBSAMPLED = """
    t AS (SELECT a2.*, frames_count FROM a2 JOIN a1 USING (camera_id, video_id)),
    f AS (SELECT DISTINCT camera_id, video_id, unnest(range(frame_begin, frame_end + 1)) AS frame FROM t),
    s AS (SELECT camera_id, video_id, list(frame ORDER BY frame) AS fs FROM f GROUP BY ALL),
    c AS (SELECT camera_id, video_id, min(frames_count) AS n,
                 CAST(coalesce(sum(frame_end - frame_begin + 1) FILTER (label = 'Foraging'), 0) AS BIGINT) AS foraging,
                 CAST(coalesce(sum(frame_end - frame_begin + 1) FILTER (label = 'Preening'), 0) AS BIGINT) AS preening,
                 CAST(coalesce(sum(frame_end - frame_begin + 1) FILTER (label = 'Resting'), 0) AS BIGINT) AS resting
          FROM t GROUP BY ALL)"""


def _counts():
    return [F.col("label_counts")[n].alias(n.lower()) for n in LABELS]


@query("subsample_frames", _SUBSAMPLED + """
    SELECT camera_id, video_id, array_to_string(fs, ',') AS target_frames, foraging, preening, resting, n AS frames_count
    FROM s JOIN c USING (camera_id, video_id)""".replace("\n    SELECT", "\n    SELECT"), "a1", "a2")
def subsample_frames(spark, d):
    return intervals.subsample_frames(tracks_with_counts(spark, d)).select(*VIDEO, text_of(), *_counts(), "frames_count")


@query("label_counts_pivot", _SUBSAMPLED + """
    SELECT camera_id, video_id, foraging AS "Foraging", preening AS "Preening", resting AS "Resting" FROM c""", "a1", "a2")
def label_counts_pivot(spark, d):
    return intervals.pivot_label_counts(tracks_with_counts(spark, d), LABELS)


_RESTS = _SUBSAMPLED + """,
    k AS (SELECT *, len(list_filter(range(1, n + 1), lambda x: NOT list_contains(fs, x))) AS free,
                 greatest(foraging, preening, resting) AS most, n - len(fs) AS remaining
          FROM s JOIN c USING (camera_id, video_id)),
    w AS (SELECT *, CASE WHEN most > remaining THEN remaining ELSE least(most, free) END AS added FROM k),
    x AS (SELECT camera_id, video_id, added, fs, unnest(list_filter(range(1, n + 1), lambda x: NOT list_contains(fs, x))) AS frame FROM w),
    o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, video_id
            ORDER BY md5('42|' || camera_id || '|' || video_id || '|' || CAST(frame AS VARCHAR)), frame) AS rn FROM x),
    p AS (SELECT camera_id, video_id, list(frame ORDER BY rn) AS more FROM o WHERE rn <= added GROUP BY ALL)"""


@query("sample_rest_frames", _RESTS + """
    SELECT camera_id, video_id, CAST(added AS BIGINT) AS added_rests,
           array_to_string(list_concat(fs, coalesce(more, [])), ',') AS target_frames
    FROM w LEFT JOIN p USING (camera_id, video_id)""", "a1", "a2")
def sample_rest_frames(spark, d):
    guidance = intervals.subsample_frames(tracks_with_counts(spark, d))
    return intervals.sample_rest_frames(guidance, SEED).select(*VIDEO, "added_rests", text_of())


_CAMERAS = """
    cams AS (SELECT camera_id, row_number() OVER (ORDER BY md5('42|' || camera_id), camera_id) AS k, count(*) OVER () AS n
             FROM (SELECT DISTINCT camera_id FROM a1)),
    splits AS (SELECT camera_id, CASE
                 WHEN k <= round_even(CAST(0.70 AS DOUBLE) * n, 0) THEN 'train'
                 WHEN k <= round_even(CAST(0.70 AS DOUBLE) * n, 0) + round_even(CAST(0.15 AS DOUBLE) * n, 0) THEN 'val'
                 ELSE 'test' END AS split FROM cams)"""


@query("camera_split", _CAMERAS + " SELECT camera_id, split FROM splits", "a1")
def camera_split(spark, d):
    return intervals.camera_splits(adapter(spark, d, "a1"), RATIOS, SEED)


@query("split_guidance", _CAMERAS + "," + _SUBSAMPLED + """,
    v AS (SELECT camera_id, video_id, video_path, frames_count, frames_count / duration AS fps, split FROM a1 JOIN splits USING (camera_id))
    SELECT v.camera_id, v.video_id, video_path, fps, split,
           array_to_string(CASE WHEN split = 'test' THEN range(1, frames_count + 1) ELSE fs END, ',') AS target_frames,
           CASE WHEN split <> 'test' THEN foraging END AS foraging, CASE WHEN split <> 'test' THEN preening END AS preening,
           CASE WHEN split <> 'test' THEN resting END AS resting
    FROM v LEFT JOIN s USING (camera_id, video_id) LEFT JOIN c USING (camera_id, video_id)
    WHERE split = 'test' OR fs IS NOT NULL""", "a1", "a2")
def split_guidance(spark, d):
    out = split.split_guidance(adapter(spark, d, "a1"), adapter(spark, d, "a2"), RATIOS, SEED)
    return out.select(*VIDEO, "video_path", "fps", "split", text_of(), *_counts())


@query("split_guidance_rests", _CAMERAS + "," + _RESTS + """
    SELECT a1.camera_id, a1.video_id, split, CASE WHEN split <> 'test' THEN CAST(added AS BIGINT) END AS added_rests,
           array_to_string(CASE WHEN split = 'test' THEN range(1, frames_count + 1) ELSE list_concat(fs, coalesce(more, [])) END, ',') AS target_frames
    FROM a1 JOIN splits USING (camera_id) LEFT JOIN (SELECT camera_id, video_id, added, fs FROM w) w USING (camera_id, video_id)
    LEFT JOIN p USING (camera_id, video_id) WHERE split = 'test' OR fs IS NOT NULL""", "a1", "a2")
def split_guidance_rests(spark, d):
    out = split.split_guidance(adapter(spark, d, "a1"), adapter(spark, d, "a2"), RATIOS, SEED, sample_rests=True)
    return out.select(*VIDEO, "split", "added_rests", text_of())


@query("all_frames_guidance", """
    SELECT video_path, true_fps AS fps, array_to_string(range(1, frames_count + 1), ',') AS target_frames FROM a1""", "a1")
def all_frames_guidance(spark, d):
    videos = adapter(spark, d, "a1")
    meta = videos.select(*VIDEO, "true_fps", F.col("frames_count").alias("frame_count"))
    return split.all_frames_guidance(videos.select(*VIDEO, "video_path"), meta).select("video_path", "fps", text_of())


def _guidance(spark, d) -> DataFrame:
    videos = adapter(spark, d, "a1")
    return videos.join(intervals.camera_splits(videos, RATIOS, SEED), "camera_id").select("video_path", "split")


def _index(spark, d) -> DataFrame:
    return clips.clip_index(adapter(spark, d, "a2"), adapter(spark, d, "a1"), _guidance(spark, d))


_INDEX = _CAMERAS + """,
    idx AS (SELECT track_id, camera_id, video_id, label, frame_begin, frame_end, split
            FROM a2 JOIN a1 USING (camera_id, video_id) JOIN splits USING (camera_id))"""


@query("clip_index", _INDEX + " SELECT * FROM idx", "a1", "a2")
def clip_index(spark, d):
    return _index(spark, d)


@query("crop_plan", _INDEX + """,
    f AS (SELECT camera_id, video_id, split, unnest(range(frame_begin, frame_end + 1)) AS frame FROM idx)
    SELECT camera_id, video_id, frame, min(split) AS split FROM f GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY camera_id, video_id, frame"), "a1", "a2")
def crop_plan(spark, d):
    return clips.crop_list(_index(spark, d), VIDEO)


@query("anti_existing", _INDEX + """,
    f AS (SELECT DISTINCT camera_id, video_id, unnest(range(frame_begin, frame_end + 1)) AS frame FROM idx)
    SELECT camera_id, video_id, frame FROM f ANTI JOIN
      (SELECT camera_id, video_id, unnest(range(1, frames_count + 1, 3)) AS frame FROM a1) e USING (camera_id, video_id, frame)""", "a1", "a2")
def anti_existing(spark, d):
    planned = clips.crop_list(_index(spark, d), VIDEO).drop("split")
    held = adapter(spark, d, "a1").select(*VIDEO, F.explode(frames_between(F.lit(1), F.col("frames_count"))).alias("frame"))
    return missing_only(planned, held.filter("frame % 3 = 1"), [*VIDEO, "frame"])


@query("behavior_clips", _INDEX + """,
    have AS (SELECT camera_id, video_id, unnest(range(1, frames_count + 1)) AS frame FROM a1),
    r AS (SELECT idx.*, frame, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY idx.camera_id, idx.video_id, track_id) AS n
          FROM idx JOIN have h ON h.camera_id = idx.camera_id AND h.video_id = idx.video_id
               AND frame BETWEEN frame_begin AND frame_end AND frame % 7 <> 0
          WINDOW w AS (PARTITION BY idx.camera_id, idx.video_id, track_id ORDER BY frame)),
    k AS (SELECT *, unnest(range(0, n - 15, 8)) AS s FROM r WHERE n >= 16)
    SELECT split, lower(label) AS label, track_id, s // 8 AS clip_idx, rn - s AS pos, frame FROM k WHERE rn - s BETWEEN 0 AND 15""", "a1", "a2")
def behavior_clips(spark, d):
    have = adapter(spark, d, "a1").select(*VIDEO, F.explode(frames_between(F.lit(1), F.col("frames_count"))).alias("frame"))
    return clips.behavior_clips(_index(spark, d), have.filter("frame % 7 <> 0"))


@query("keyframe_interpolate", """
    n AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(width) OVER w AS nw, lead(height) OVER w AS nh
          FROM a3 WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
    e AS (SELECT *, unnest(range(frame, coalesce(nf, frame + 1))) AS f FROM n),
    s AS (SELECT *, CAST(f - frame AS DOUBLE) / (nf - frame) AS p FROM e)
    SELECT track_id, f AS frame, CASE WHEN f = frame THEN x ELSE x + (nx - x) * p END AS x,
           CASE WHEN f = frame THEN y ELSE y + (ny - y) * p END AS y,
           CASE WHEN f = frame THEN width ELSE width + (nw - width) * p END AS width,
           CASE WHEN f = frame THEN height ELSE height + (nh - height) * p END AS height FROM s""", "a3")
def keyframe_interpolate(spark, d):
    return intervals.interpolate_keyframes(adapter(spark, d, "a3"), ["track_id"])


@query("smooth_centers", """
    n AS (SELECT track_id, frame, x, y, count(*) OVER (PARTITION BY track_id) AS n FROM a3),
    s AS (SELECT *, sum(x) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x5, sum(y) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y5,
            sum(x) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS x4, sum(y) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS y4,
            sum(x) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x3, sum(y) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y3,
            sum(x) OVER (o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x2, sum(y) OVER (o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS y2
          FROM n WINDOW o AS (PARTITION BY track_id ORDER BY frame))
    SELECT track_id, frame,
      CASE WHEN n >= 5 THEN x5 / 5 WHEN n = 4 THEN x4 / 4 WHEN n = 3 THEN x3 / 3 WHEN n = 2 THEN x2 / 2 ELSE x END AS smooth_x,
      CASE WHEN n >= 5 THEN y5 / 5 WHEN n = 4 THEN y4 / 4 WHEN n = 3 THEN y3 / 3 WHEN n = 2 THEN y2 / 2 ELSE y END AS smooth_y FROM s""", "a3")
def smooth_centers(spark, d):
    rows = adapter(spark, d, "a3").select("track_id", "frame", "x", "y")
    return intervals.smooth_centers(rows, ["track_id"], "x", "y").select("track_id", "frame", "smooth_x", "smooth_y")


def nested_tasks(spark, d) -> DataFrame:
    """The nested form of the flat view: one task per order; a task without lines has no results."""
    result = F.when(F.col("track_id").isNotNull(), F.struct(
        F.col("track_id").alias("id"),
        F.struct(F.array("label").alias("labels"), F.array(F.struct(
            F.col("frame").cast("bigint").alias("frame"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("width"),
            F.lit(4.0).alias("height"))).alias("sequence")).alias("value")))
    tasks = adapter(spark, d, "a8", TASK_KEYS).groupBy("video_idx").agg(F.collect_list(result).alias("result"))
    return tasks.select(
        F.lit("labeler").alias("labeler"), F.col("video_idx").alias("inner_id"),
        F.when(F.col("video_idx") % 10 == 0, 0).otherwise(1).cast("bigint").alias("total_annotations"),
        F.struct(F.lit("/c/v.mp4").alias("video"), F.lit(100).cast("bigint").alias("framesCount"), F.lit(4.0).alias("duration")).alias("data"),
        F.array(F.struct(F.lit(1).cast("bigint").alias("id"), F.col("result"))).alias("annotations"))


@query("flatten_annotations", "SELECT video_idx, track_id, CASE WHEN track_id IS NOT NULL THEN label END AS label, frame FROM a8 WHERE video_idx % 10 <> 0", "a8")
def flatten_annotations(spark, d):
    rows = labels.flatten_results(labels.annotated(nested_tasks(spark, d)))
    return rows.select("video_idx", "track_id", "label", F.explode_outer("sequence").alias("k")).select("video_idx", "track_id", "label", "k.frame")


@query("annotation_tracks", """
    SELECT video_idx, track_id, min(label) AS label, min(frame) + 1 AS frame_begin,
           CASE WHEN min(frame) = max(frame) THEN 100 ELSE max(frame) + 1 END AS frame_end,
           avg((1.0::DOUBLE + 3.0::DOUBLE / 2) / 100) AS mean_x
    FROM a8 WHERE video_idx % 10 <> 0 AND frame IS NOT NULL GROUP BY video_idx, track_id""", "a8")
def annotation_tracks(spark, d):
    frames = labels.keyframes(labels.flatten_results(labels.annotated(nested_tasks(spark, d))))
    tracks = labels.extend_single_keyframes(labels.track_rollup(frames, ("labeler", "video_idx", "track_id")))
    return tracks.select("video_idx", "track_id", "label", "frame_begin", "frame_end", "mean_x")


@query("semi_split_filter", _CAMERAS + " SELECT track_id, label FROM a2 WHERE camera_id IN (SELECT camera_id FROM splits WHERE split = 'train')", "a1", "a2")
def semi_split_filter(spark, d):
    splits = intervals.camera_splits(adapter(spark, d, "a1"), RATIOS, SEED)
    return filters.in_splits(adapter(spark, d, "a2"), splits, "train").select("track_id", "label")


@query("random_frames", """
    f AS (SELECT camera_id, video_id, unnest(range(1, frames_count + 1)) AS frame FROM a1),
    o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, video_id
            ORDER BY md5('42|' || camera_id || '|' || video_id || '|' || CAST(frame AS VARCHAR)), frame) AS rn FROM f)
    SELECT camera_id, video_id, array_to_string(list(frame ORDER BY frame), ',') AS frames FROM o WHERE rn <= 3 GROUP BY camera_id, video_id""", "a1")
def random_frames(spark, d):
    return intervals.random_frames(adapter(spark, d, "a1"), 3, SEED).select(*VIDEO, text_of("frames"))


@query("path_parse", r"""
    SELECT video_path, replace(string_split(video_path, '/')[-2], '%2C', ',') AS camera, string_split(video_path, '/')[-1] AS file,
           regexp_replace(string_split(video_path, '/')[-1], '\.[^.]+$', '') AS video, string_split(string_split(video_path, '/')[-1], '.')[1] AS first_dot,
           string_split(video_path, '.')[-1] AS ext, string_split(video_path, '/data/')[-1] AS rest,
           replace(string_split(video_path, '/data/')[-1], '/', '.') AS dotted,
           replace(camera_id, ',', '%2C') || '.' || video_id || '_frame_' || lpad(CAST(frames_count AS VARCHAR), 5, '0') || '_cage_c1' AS stem,
           frames_count AS frame
    FROM a1""", "a1")
def path_parse(spark, d):
    p = F.col("video_path")
    rows = adapter(spark, d, "a1").select(
        "video_path", paths.camera_id(p).alias("camera"), paths.video_name(p).alias("file"), paths.video_id(p).alias("video"),
        paths.video_id(p, first_dot=True).alias("first_dot"), paths.extension(p).alias("ext"), paths.after_marker(p, "/data/").alias("rest"),
        paths.dotted(paths.after_marker(p, "/data/")).alias("dotted"),
        paths.frame_stem(F.col("camera_id"), F.col("video_id"), F.col("frames_count"), F.lit("c1")).alias("stem"))
    return rows.withColumn("frame", paths.frame_from_name(F.col("stem")))


@query("label_histogram", "SELECT label, count(DISTINCT track_id) AS n FROM a2 GROUP BY label", "a2")
def label_histogram(spark, d):
    return evaluation.label_histogram(adapter(spark, d, "a2"))


@query("seed_videos", "SELECT camera_id, min(video_id) AS video_id FROM a1 GROUP BY camera_id", "a1")
def seed_videos(spark, d):
    return split.seed_videos(adapter(spark, d, "a1"))


@query("guidance_quality", "SELECT camera_id, video_id, count(*) AS n FROM a2 GROUP BY camera_id, video_id HAVING count(*) <> 1", "a2")
def guidance_quality(spark, d):
    return split.one_guidance_per_video(adapter(spark, d, "a2"))


QUERIES["contact_filter"] = lambda spark, d: filters.contacts(
    table(spark, d, "customer"), ["c_name", "c_mktsegment"], ("c_name", "7"), ("c_mktsegment", ["BUILDING", "MACHINERY"])
).select("c_custkey", "c_name", "c_mktsegment")
ORACLE_SQL["contact_filter"] = """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE (c_name <> '' OR c_mktsegment <> '') AND contains(c_name, '7') AND c_mktsegment IN ('BUILDING', 'MACHINERY')"""
QUERIES["relaxed_union"] = lambda spark, d: labels.relaxed_union([
    adapter(spark, d, "a1").select("video_id", F.col("frames_count").alias("n")),
    adapter(spark, d, "a2").select("video_id", F.col("frame_end").cast("double").alias("n"), "label")])
ORACLE_SQL["relaxed_union"] = oracle("""
    SELECT video_id, CAST(frames_count AS DOUBLE) AS n, NULL AS label FROM a1 UNION ALL
    SELECT video_id, CAST(frame_end AS DOUBLE), label FROM a2""", "a1", "a2")
QUERIES["lookup_one"] = lambda spark, d: lookups.lookup_one(table(spark, d, "nation"), "n_nationkey", 7)
ORACLE_SQL["lookup_one"] = "SELECT * FROM nation WHERE n_nationkey = 7"
QUERIES["pick_one"] = lambda spark, d: lookups.pick_one(adapter(spark, d, "a1").select("camera_id", "video_id"), SEED, VIDEO)
ORACLE_SQL["pick_one"] = oracle("""
    SELECT camera_id, video_id FROM a1 ORDER BY md5('42|' || camera_id || '|' || video_id), camera_id, video_id LIMIT 1""", "a1")
