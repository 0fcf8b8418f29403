"""Queries of annotation tasks, of what is written and read back, and of pixels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions import paths
from tracklens.operators import boxes, evaluation, images, labels, masks
from tracklens.plans import mask_queries
from tracklens.plans.adapters import TASK_KEYS, adapter, oracle, table, tasks_for
from tracklens.plans.interval_queries import VIDEO
from tracklens.plans.mask_queries import _ASKED, _BY, _MATCHED, _PAIRS, _SEGMENTS, SIDE
from tracklens.plans.scratch import scratch_dir
from tracklens.sources import readers, schemas, sinks
from tracklens.streaming.ingest import annotation_stream, ingest_annotations, ingested_lines

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str, *views: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


# --- annotation tasks -------------------------------------------------------------------------------------------------

#: One video per task; a track has two keyframes, a preening one a single keyframe.
_FLAT = """
    task AS (SELECT DISTINCT video_idx, concat('H', CAST(video_idx % 7 AS STRING), ',I', CAST(video_idx % 5 AS STRING)) AS camera_id,
               concat('v', CAST(video_idx AS STRING)) AS video_id, CAST(24 + video_idx % 13 AS DOUBLE) AS true_fps,
               CAST(60 + video_idx % 40 AS BIGINT) AS n FROM a8 WHERE video_idx % 10 <> 0),
    flat AS (SELECT video_idx, track_id, label, frame AS f0, CASE WHEN label = 'Preening' THEN frame ELSE frame + 2 + result_no END AS f1
             FROM a8 WHERE video_idx % 10 <> 0 AND track_id IS NOT NULL)"""


def _tasks(spark, d) -> DataFrame:
    at = lambda frame, x: F.struct(
        frame.cast("bigint").alias("frame"), F.lit(float(x)).alias("x"), F.lit(20.0).alias("y"), F.lit(30.0).alias("width"),
        F.lit(40.0).alias("height"))
    first, last = at(F.col("frame"), 10), at(F.col("frame") + 2 + F.col("result_no"), 20)
    sequence = F.when(F.col("label") == "Preening", F.array(first)).otherwise(F.array(first, last))
    result = F.when(F.col("track_id").isNotNull(), F.struct(
        F.col("track_id").alias("id"), F.struct(F.array("label").alias("labels"), sequence.alias("sequence")).alias("value")))
    rows = adapter(spark, d, "a8", TASK_KEYS).groupBy("video_idx").agg(F.collect_list(result).alias("result"))
    text = lambda c: c.cast("string")
    path = F.concat(F.lit("/data/H"), text(F.col("video_idx") % 7), F.lit("%2CI"), text(F.col("video_idx") % 5), F.lit("/v"),
                    text(F.col("video_idx")), F.lit(".mp4"))
    return rows.select(
        F.concat(F.lit("labeler"), text(F.col("video_idx") % 2)).alias("labeler"), F.col("video_idx").alias("inner_id"),
        F.when(F.col("video_idx") % 10 == 0, 0).otherwise(1).cast("bigint").alias("total_annotations"),
        F.struct(path.alias("video"), F.lit(100).cast("bigint").alias("framesCount"), F.lit(4.0).alias("duration")).alias("data"),
        F.array(F.struct(F.lit(1).cast("bigint").alias("id"), F.col("result"))).alias("annotations"))


#: Tasks of one JSON array file.
TASKS_A_FILE = 2048


def _containers(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("H"), (k % 7).cast("string"), F.lit(",I"), (k % 5).cast("string")).alias("camera_id"),
        F.concat(F.lit("v"), k.cast("string")).alias("video_id"), (24 + k % 13).cast("double").alias("true_fps"),
        (60 + k % 40).cast("bigint").alias("frame_count"))


@query("label_videos", _FLAT + """
    SELECT '/data/' || replace(camera_id, ',', '%2C') || '/' || video_id || '.mp4' AS video_path, n AS frames_count, CAST(4 AS DOUBLE) AS duration,
           camera_id, video_id, 'mp4' AS video_ext, true_fps FROM task""", "a8")
def label_videos(spark, d):
    return labels.label_tables(_tasks(spark, d), _containers(spark, d))[0]


@query("label_tracks", _FLAT + """,
    scaled AS (SELECT track_id, label, camera_id, video_id, n, f0 = f1 AS single, CAST(trunc((f0 + 1) * (true_fps / 25)) AS BIGINT) AS b,
                      CAST(trunc((CASE WHEN f0 = f1 THEN 100 ELSE f1 + 1 END) * (true_fps / 25)) AS BIGINT) AS e FROM flat JOIN task USING (video_idx)),
    rest AS (SELECT * EXCLUDE (e), CASE WHEN label = 'Resting' THEN b + 15 ELSE e END AS e FROM scaled),
    grown AS (SELECT *, CASE WHEN e - b + 1 < 16 THEN (16 - (e - b + 1) + 1) // 2 ELSE 0 END AS g FROM rest),
    moved AS (SELECT *, b - g AS nb, e + g AS ne FROM grown)
    SELECT track_id, label, camera_id, video_id, CAST(greatest(1, nb - CASE WHEN ne > n THEN ne - n ELSE 0 END) AS BIGINT) AS frame_begin,
           CAST(least(n, ne + CASE WHEN nb < 0 THEN abs(nb) + 1 ELSE 0 END) AS BIGINT) AS frame_end,
           CASE WHEN single THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS mean_x FROM moved""", "a8")
def label_tracks(spark, d):
    tracks = labels.label_tables(_tasks(spark, d), _containers(spark, d))[1]
    return tracks.select("track_id", "label", *VIDEO, "frame_begin", "frame_end", F.round("mean_x", 6).alias("mean_x"))


@query("labeler_union", "SELECT camera_id, video_id, frames_count FROM a1 UNION ALL SELECT camera_id, video_id, frames_count FROM a1 WHERE frames_count % 2 = 0", "a1")
def labeler_union(spark, d):
    videos = adapter(spark, d, "a1").select(*VIDEO, "frames_count")
    return labels.strict_union([videos.filter("frames_count % 2 = 1"), videos.filter("frames_count % 2 = 0"), videos.filter("frames_count % 2 = 0")])


_SHOWN = _FLAT + """,
    asked AS (SELECT *, unnest(range(1, n + 1)) AS frame FROM task),
    keyed AS (SELECT video_idx, track_id, f0 AS shown_at, CAST(0.25 AS DOUBLE) AS xc FROM flat
              UNION ALL SELECT video_idx, track_id, f1, CAST(0.35 AS DOUBLE) FROM flat WHERE f1 <> f0)
    SELECT camera_id, video_id, frame, track_id, xc
    FROM asked LEFT JOIN keyed ON keyed.video_idx = asked.video_idx AND shown_at = CAST(trunc(frame * CAST(25 AS DOUBLE) / true_fps) AS BIGINT)"""


def _asked_frames(spark, d) -> DataFrame:
    """All frames of every video, as stretches: no table holds a row or an element for each."""
    whole = F.lit(1).cast("bigint").alias("frame_begin"), F.col("frame_count").alias("frame_end")
    return _containers(spark, d).select(*VIDEO, *whole, F.lit(25.0).alias("ls_fps"), F.col("true_fps").alias("fps"))


@query("annotation_lines", _SHOWN, "a8")
def annotation_lines(spark, d):
    lines = boxes.annotation_lines(labels.annotated(_tasks(spark, d)), _asked_frames(spark, d))
    return lines.select(*VIDEO, "frame", "track_id", F.round("xc", 6).alias("xc"))


def tasks_videos(tasks: DataFrame) -> DataFrame:
    path = F.col("data.video")
    return tasks.select(paths.camera_id(path).alias("camera_id"), paths.video_id(path).alias("video_id")).distinct()


#: Results of tasks whose boxes one partition of a stream's state holds.
RESULTS_A_STATE = 1_000_000


def _state_partitions(spark, d) -> int:
    return tasks_for(spark, d, "lineitem", RESULTS_A_STATE)


@query("stream_ingest", _SHOWN, "a8")
def stream_ingest(spark, d):
    """The same through the stream, tasks arriving in two batches. Files hold what one task nests, so they grow in number and not in size; repeated names
    and shapes make line JSON many times as large as the tables, so it is packed."""
    root = scratch_dir(spark, "ingest")
    tasks = labels.annotated(_tasks(spark, d)).drop("labeler")
    sinks.write_ndjson(tasks, f"{root}/in", compression="gzip")
    targets = _asked_frames(spark, d)
    half = -(-readers.count_files(spark, f"{root}/in") // 2)
    stream = ingest_annotations(annotation_stream(spark, f"{root}/in", max_files=half), targets, f"{root}/out", f"{root}/state", _state_partitions(spark, d), "zstd")
    stream.awaitTermination()
    lines = ingested_lines(spark, f"{root}/out", targets, tasks_videos(tasks), ("track_id", "xc"))
    return lines.select(*VIDEO, "frame", "track_id", F.round("xc", 6).alias("xc"))


@query("annotation_files", "SELECT video_idx, track_id, CASE WHEN track_id IS NOT NULL THEN label END AS label FROM a8 WHERE video_idx % 10 <> 0", "a8")
def annotation_files(spark, d):
    """Tasks written as JSON array files and read back. A file is read by one task, so there are more files of more tasks, not larger ones."""
    root = scratch_dir(spark, "exports")
    parts = _tasks(spark, d).withColumn("part", F.floor(F.col("inner_id") / TASKS_A_FILE)).groupBy("part").agg(
        F.to_json(F.collect_list(F.struct("inner_id", "total_annotations", "data", "annotations"))).alias("value"))
    parts.write.mode("overwrite").partitionBy("part").text(root)
    return labels.flatten_results(labels.annotated(readers.read_annotations(spark, root))).select("video_idx", "track_id", "label")


# --- crops and pixels -------------------------------------------------------------------------------------------------

_HELD = _SEGMENTS + _ASKED + """,
    keyed AS (SELECT c.video_id, s.segment_idx, c.cage_id, y, x, lit FROM cells c JOIN segs s ON s.video_id = c.video_id AND s.start = c.frame),
    bb AS (SELECT video_id, segment_idx, cage_id, CAST(min(x) AS BIGINT) AS x_min, CAST(min(y) AS BIGINT) AS y_min,
                  CAST(max(x) AS BIGINT) AS x_max, CAST(max(y) AS BIGINT) AS y_max FROM keyed WHERE lit GROUP BY video_id, segment_idx, cage_id)"""


def _held(spark, d):
    segments = mask_queries._segments(spark, d)
    runs = masks.keyframe_masks(mask_queries._runs(spark, d), segments, ["video_id"])
    return segments, runs, masks.mask_boxes(runs, ["video_id", "segment_idx", "cage_id"], SIDE, SIDE)


@query("plan_crops", _HELD + """
    SELECT l.video_id, l.frame, l.segment_idx, bb.cage_id, x_min, y_min, x_max, y_max
    FROM looked l CROSS JOIN (SELECT unnest(['c0', 'c1', 'c9']) AS cage_id) k
    JOIN bb ON bb.video_id = l.video_id AND bb.segment_idx = l.segment_idx AND bb.cage_id = k.cage_id WHERE l.frame % 3 <> 0""", "a4")
def plan_crops(spark, d):
    segments, _, held = _held(spark, d)
    cages = F.explode(F.array(*(F.lit(c) for c in ("c0", "c1", "c9"))))
    crops = mask_queries._asked(spark, d).withColumn("cage_id", cages)
    return masks.plan_crops(crops, segments, held, crops.filter("frame % 3 = 0"), ["video_id"])


def _frames_as_images(spark, d) -> DataFrame:
    """An 8 x 8 grey image per frame, each pixel a number of its place and frame."""
    rows = adapter(spark, d, "a4").select("video_id", "frame").distinct()
    pixel = lambda i: F.lpad(F.hex((i * 7 + F.col("frame")) % 251 + 1), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel), ""))
    return rows.select(
        "video_id", "frame", F.concat_ws("_", "video_id", "frame").alias("origin"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))


CAGE_PIXELS = _HELD + """,
    have AS (SELECT DISTINCT video_id, frame FROM a4),
    job AS (SELECT l.video_id, l.frame, bb.* EXCLUDE (video_id) FROM looked l JOIN have USING (video_id, frame)
            JOIN bb ON bb.video_id = l.video_id AND bb.segment_idx = l.segment_idx),
    px AS (SELECT j.video_id, j.frame, j.cage_id, k.y, k.x, x_max - x_min + 1 AS width, y_max - y_min + 1 AS height,
                  CASE WHEN lit THEN ((8 * k.y + k.x) * 7 + j.frame) % 251 + 1 ELSE 0 END AS v
           FROM job j JOIN keyed k ON k.video_id = j.video_id AND k.segment_idx = j.segment_idx AND k.cage_id = j.cage_id
                AND k.y BETWEEN y_min AND y_max AND k.x BETWEEN x_min AND x_max)
    SELECT video_id || '_' || frame || '_cage_' || cage_id AS origin, CAST(max(height) AS INTEGER) AS height, CAST(max(width) AS INTEGER) AS width,
           string_agg(printf('%02X', v), '' ORDER BY y, x) AS pixels FROM px GROUP BY video_id, frame, cage_id"""


@query("cage_pixels", CAGE_PIXELS, "a4")
def cage_pixels(spark, d):
    segments, runs, held = _held(spark, d)
    frames = adapter(spark, d, "a4").groupBy("video_id").agg(F.collect_set("frame").alias("target_frames"))
    plan = masks.plan_all_cages(frames, segments, held, ["video_id"])
    cut = images.crop_images_mask(masks.crop_jobs(plan, runs, _frames_as_images(spark, d), ["video_id"]))
    return cut.select("origin", "height", "width", F.hex("data").alias("pixels"))


_SQUARES = """
    have AS (SELECT DISTINCT video_id, frame FROM a4),
    line AS (SELECT video_id, frame, 0 AS line_no, frame % 2 = 0 AS two, frame % 8 AS px, video_id % 5 AS py FROM have
             UNION ALL SELECT video_id, frame, 1, true, 7, 7 FROM have WHERE frame % 2 = 0)"""


@query("square_pixels", _SQUARES + """,
    grid AS (SELECT *, unnest(range(0, 16)) AS i FROM line),
    px AS (SELECT *, px - 2 + i % 4 AS x, py - 2 + i // 4 AS y FROM grid)
    SELECT video_id || '_' || frame || CASE WHEN two THEN '_bird_' || line_no ELSE '' END AS origin, 4 AS height, 4 AS width,
           string_agg(printf('%02X', CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN ((8 * y + x) * 7 + frame) % 251 + 1 ELSE 0 END), '' ORDER BY i) AS pixels
    FROM px GROUP BY video_id, frame, line_no, two""", "a4")
def square_pixels(spark, d):
    shots = _frames_as_images(spark, d)
    first = shots.withColumns({"line_no": F.lit(0), "xc": (F.col("frame") % 8) / 8.0, "yc": (F.col("video_id") % 5) / 8.0})
    second = shots.filter("frame % 2 = 0").withColumns({"line_no": F.lit(1), "xc": F.lit(0.9), "yc": F.lit(0.99)})
    lines = boxes.square_crops(first.unionByName(second), ["video_id", "frame"], SIDE, SIDE, 4)
    cut = images.crop_images_square(lines.withColumn("origin", F.concat("origin", "suffix")))
    return cut.select("origin", "height", "width", F.hex("data").alias("pixels"))


# --- labels and evaluation --------------------------------------------------------------------------------------------

_W, _H = 200, 120
_TRUE = f"""
    line AS (SELECT video_id, cage_id, frame, (gt_left + w / 2) / {_W} AS xc, (gt_top + h / 2) / {_H} AS yc, w / {_W} AS w, h / {_H} AS h,
                    row_number() OVER (PARTITION BY video_id ORDER BY frame, cage_id) - 1 AS line_no FROM a5 WHERE has_gt)"""


def _true_lines(spark, d) -> DataFrame:
    rows = adapter(spark, d, "a5").filter("has_gt")
    return rows.select(
        "video_id", "cage_id", "frame", F.lit(0).alias("class_id"), ((F.col("gt_left") + F.col("w") / 2) / _W).alias("xc"),
        ((F.col("gt_top") + F.col("h") / 2) / _H).alias("yc"), (F.col("w") / _W).alias("w"), (F.col("h") / _H).alias("h"))


@query("detector_table", _TRUE + f"""
    SELECT video_id, cage_id, frame, {_W} AS width, {_H} AS height, round(xc * {_W} - 0.5 * w * {_W}, 6) AS x0, round(yc * {_H} - 0.5 * h * {_H}, 6) AS y0,
           round(xc * {_W} + 0.5 * w * {_W}, 6) AS x1, round(yc * {_H} + 0.5 * h * {_H}, 6) AS y1 FROM line WHERE frame % 2 = 0""", "a5")
def detector_table(spark, d):
    lines = _true_lines(spark, d)
    shots = lines.filter("frame % 2 = 0").select(*_BY, "frame", F.lit(_W).alias("width"), F.lit(_H).alias("height"))
    corners = ("x0", "y0", "x1", "y1")
    return boxes.detector_table(lines, shots, [*_BY, "frame"]).select(
        *_BY, "frame", "width", "height", *(F.round(c, 6).alias(c) for c in corners))


@query("tracked_sequences", "SELECT video_id, cage_id, frame FROM a5 WHERE has_gt AND (video_id + cage_id) % 2 = 0", "a5")
def tracked_sequences(spark, d):
    rows = adapter(spark, d, "a5")
    manifest = rows.filter("(video_id + cage_id) % 2 = 0")
    return evaluation.tracked_sequences(rows.filter("has_gt"), manifest, _BY).select(*_BY, "frame")


@query("not_trained_on", "SELECT camera_id, video_id FROM a1 WHERE frames_count % 3 <> 0", "a1")
def not_trained_on(spark, d):
    videos = adapter(spark, d, "a1").select(*VIDEO, "frames_count")
    return evaluation.not_trained_on(videos, videos.filter("frames_count % 3 = 0").select(*VIDEO)).select(*VIDEO)


@query("within_video", "SELECT track_id, frame_end AS frame FROM a2 JOIN a1 USING (camera_id, video_id) WHERE frame_end <= frames_count - 20", "a1", "a2")
def within_video(spark, d):
    counts = adapter(spark, d, "a1").select(*VIDEO, (F.col("frames_count") - 20).alias("frame_count"))
    targets = adapter(spark, d, "a2").withColumn("frame", F.col("frame_end")).join(counts, VIDEO)
    return boxes.within_video(targets).select("track_id", "frame")


def label_defects(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.col("text").alias("value")).filter("value <> ''")
    return boxes.five_values_only(lines).select("doc_id")


QUERIES["label_defects"] = label_defects
ORACLE_SQL["label_defects"] = r"""
    SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' AND len(string_split_regex(trim(text), '\s+')) <> 5"""


#: Two animals a sequence, far apart, each with predicted ids of its own: the best assignment is that of each animal. The first
#: cage is alone in its sequence, so simple and crowded sequences are in one table.
@query("crowded_tracking", _MATCHED + """,
    x AS (SELECT *, last_value(CASE WHEN hit THEN pred_id END IGNORE NULLS) OVER e AS last_id,
                 last_value(CASE WHEN has_gt THEN hit END IGNORE NULLS) OVER e AS was_hit,
                 max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, cage_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
          FROM m WINDOW e AS (PARTITION BY video_id, cage_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT video_id, cage_id, count(*) FILTER (has_gt) AS num_objects, count(*) FILTER (has_pred) AS num_predictions, count(*) FILTER (hit) AS hits,
                 count(*) FILTER (hit AND last_id <> pred_id) AS num_switches, count(*) FILTER (has_gt AND NOT hit AND was_hit AND later = 1) AS num_fragmentations,
                 coalesce(sum(1 - iou) FILTER (hit), 0) AS dist FROM x GROUP BY video_id, cage_id),
    t AS (SELECT video_id, cage_id, max(n) AS idtp FROM (SELECT video_id, cage_id, pred_id, count(*) AS n FROM m WHERE hit GROUP BY ALL) GROUP BY video_id, cage_id),
    f AS (SELECT video_id, cage_id // 2 AS pair, count(DISTINCT frame) AS num_frames FROM m GROUP BY video_id, cage_id // 2),
    g2 AS (SELECT video_id, cage_id // 2 AS pair, CAST(sum(num_objects) AS BIGINT) AS num_objects, CAST(sum(num_predictions) AS BIGINT) AS num_predictions,
                  CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(num_switches) AS BIGINT) AS num_switches, CAST(sum(num_fragmentations) AS BIGINT) AS num_fragmentations,
                  sum(dist) AS dist, CAST(sum(coalesce(idtp, 0)) AS BIGINT) AS idtp,
                  count(*) FILTER (num_objects > 0 AND hits >= CAST(0.8 AS DOUBLE) * num_objects) AS mostly_tracked
           FROM s LEFT JOIN t USING (video_id, cage_id) GROUP BY ALL)
    SELECT video_id, pair, num_frames, num_objects, num_predictions, num_objects - hits AS num_misses, num_predictions - hits AS num_false_positives,
           num_switches, num_fragmentations, mostly_tracked, round(CASE WHEN hits > 0 THEN dist / hits END, 6) AS motp,
           round(CASE WHEN num_objects > 0 THEN 1 - CAST(num_objects - hits + num_predictions - hits + num_switches AS DOUBLE) / num_objects END, 9) AS mota,
           round(CAST(2 * idtp AS DOUBLE) / (num_objects + num_predictions), 9) AS idf1
    FROM g2 JOIN f USING (video_id, pair)""", "a5")
def crowded_tracking(spark, d):
    apart, pair = 1000 * F.col("cage_id"), F.expr("cage_id div 2").alias("pair")
    root = scratch_dir(spark, "crowded")
    keep = lambda df, name: sinks.kept(df, f"{root}/{name}")
    truth, found = mask_queries._boxes(spark, d, keep(adapter(spark, d, "a5"), "boxes"))
    own = lambda df: df.select(
        "video_id", pair, "frame", (F.col("left") + apart).alias("left"), "top", "w", "h", "cage_id", *(["pred_id"] if "pred_id" in df.columns else []))
    truth = own(truth).withColumnRenamed("cage_id", "truth_id")
    found = own(found).withColumn("pred_id", F.col("pred_id") + 10 * F.col("cage_id")).drop("cage_id")
    out = evaluation.tracking_metrics(truth, found, ["video_id", "pair"], keep=keep)
    return out.select(
        "video_id", "pair", "num_frames", "num_objects", "num_predictions", "num_misses", "num_false_positives", "num_switches",
        "num_fragmentations", "mostly_tracked", F.round("motp", 6).alias("motp"), F.round("mota", 9).alias("mota"), F.round("idf1", 9).alias("idf1"))


# --- written and read back --------------------------------------------------------------------------------------------


@query("ndjson_round_trip", "SELECT * FROM a1", "a1")
def ndjson_round_trip(spark, d):
    path, rows = scratch_dir(spark, "ndjson"), adapter(spark, d, "a1")
    sinks.write_ndjson(rows, path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return readers.read_ndjson(spark, path, fields)


@query("parquet_round_trip", "SELECT track_id, camera_id, frame_end FROM a2 WHERE label = 'Resting'", "a2")
def parquet_round_trip(spark, d):
    path = scratch_dir(spark, "parquet")
    sinks.write_parquet(adapter(spark, d, "a2"), path, partition_by=("label",))
    return readers.read_parquet(spark, path, ["track_id", "camera_id", "frame_end", "label"]).filter("label = 'Resting'").drop("label")


@query("csv_round_trip", "SELECT run_id, epoch, batch_id, correct FROM a7", "a7")
def csv_round_trip(spark, d):
    path, rows = scratch_dir(spark, "csv"), adapter(spark, d, "a7").select("run_id", "epoch", "batch_id", "correct")
    for half in (rows.filter("epoch <= 6"), rows.filter("epoch > 6")):
        sinks.append_log(half, path)
    return readers.read_csv(spark, path, "run_id bigint, epoch bigint, batch_id bigint, correct int")


def _by_video(rows: DataFrame, root: str, body: str = "body") -> None:
    """One text file for each video, in a folder named after it."""
    rows.select("video_id", body).repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(root)


def _video_of(path: str = "path"):
    return F.regexp_extract(path, r"video_id=(\d+)", 1).cast("bigint").alias("video_id")


def _numbered(spark, d) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("video_id").orderBy("frame", "cage_id")
    return _true_lines(spark, d).withColumn("line_no", (F.row_number().over(order) - 1).cast("bigint"))


@query("label_round_trip", _TRUE + " SELECT video_id, line_no, CAST(0 AS BIGINT) AS class_id, CAST(printf('%.6f', xc) AS DOUBLE) AS xc, CAST(printf('%.6f', h) AS DOUBLE) AS h FROM line", "a5")
def label_round_trip(spark, d):
    root, lines = scratch_dir(spark, "labels"), _numbered(spark, d)
    _by_video(sinks.box_label_files(lines, lines, ["video_id"]), root)
    return readers.read_box_labels(spark, root).select(_video_of(), "line_no", "class_id", "xc", "h")


@query("tracking_round_trip", _TRUE + " SELECT video_id, cage_id AS track_id, count(*) AS n, CAST(0.5 AS DOUBLE) AS conf FROM line GROUP BY video_id, cage_id", "a5")
def tracking_round_trip(spark, d):
    root = scratch_dir(spark, "tracks")
    text = F.format_string("%d %.6f %.6f %.6f %.6f %.2f %d", "class_id", "xc", "yc", "w", "h", F.lit(0.5), "cage_id")
    # a line with too few fields in each file is left out when reading
    body = _numbered(spark, d).groupBy("video_id").agg(F.concat(F.lit("0 0.5 0.5 0.1 0.1\n"), F.array_join(F.collect_list(text), "\n")).alias("body"))
    _by_video(body, root)
    return readers.read_tracking_labels(spark, root).groupBy(_video_of(), "track_id").agg(F.count("*").alias("n"), F.min("conf").alias("conf"))


@query("mask_round_trip", """
    SELECT video_id, cage_id || '_' || frame AS cage_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame, cage_id) - 1 AS INTEGER) AS cage_ord,
           CAST(len(list_filter(embedding, lambda v: v > 0)) AS INTEGER) AS area FROM a4""", "a4")
def mask_round_trip(spark, d):
    root = scratch_dir(spark, "masks")
    rows = mask_queries._objects(spark, d).withColumns({
        "cage_ord": F.col("frame") * 3 + F.substring("cage_id", 2, 1).cast("int"), "cage_id": F.concat_ws("_", "cage_id", "frame")})
    _by_video(sinks.mask_json(rows, ["video_id"]), root)
    back = readers.read_mask_json(spark, root, glob="*.txt")
    return back.select(_video_of(), "cage_id", "cage_ord", masks.mask_area_array(F.col("mask")).alias("area"))


@query("segment_round_trip", _SEGMENTS + ' SELECT video_id, segment_idx, start, "end" FROM segs', "a4")
def segment_round_trip(spark, d):
    root = scratch_dir(spark, "segments")
    _by_video(sinks.segment_index_json(mask_queries._segments(spark, d), ["video_id"]), root)
    return readers.read_segment_index(spark, root, glob="*.txt").select(_video_of(), "segment_idx", "start", "end")


@query("file_list", "SELECT DISTINCT video_id, CAST(1 AS BIGINT) AS n FROM a5 WHERE has_gt", "a5")
def file_list(spark, d):
    root, lines = scratch_dir(spark, "files"), _numbered(spark, d)
    _by_video(sinks.box_label_files(lines, lines, ["video_id"]), root)
    return readers.list_files(spark, root, ("txt",)).groupBy(_video_of()).agg(F.count("*").alias("n"))


@query("report_files", _PAIRS + """,
    l AS (SELECT true_class AS label FROM p UNION SELECT pred_class FROM p)
    SELECT a.label AS true_class, b.label AS pred_class, count(p.vec_id) AS n
    FROM l a CROSS JOIN l b LEFT JOIN p ON p.true_class = a.label AND p.pred_class = b.label GROUP BY a.label, b.label""", "a6")
def report_files(spark, d):
    root = scratch_dir(spark, "report")
    sinks.write_report(mask_queries._scored(spark, d), root)
    return readers.read_parquet(spark, f"{root}/confusion_matrix")


@query("container_metadata", "SELECT a1.camera_id, a1.video_id, CASE WHEN frames_count % 4 <> 0 THEN true_fps END AS fps FROM a1", "a1")
def container_metadata(spark, d):
    videos = adapter(spark, d, "a1")
    meta = videos.filter("frames_count % 4 <> 0").select(*VIDEO, F.col("true_fps").alias("fps"), F.col("frames_count").alias("frame_count"))
    return readers.with_video_metadata(videos.select(*VIDEO), meta.select(*VIDEO, "fps")).select(*VIDEO, "fps")


@query("output_paths", """
    SELECT video_id, CASE WHEN frames_count % 2 = 0
             THEN 'test/' || replace(camera_id, ',', '%2C') || '/' || video_id || '/c1/' || replace(camera_id, ',', '%2C') || '.' || video_id || '_frame_' || lpad(CAST(frames_count AS VARCHAR), 5, '0') || '_cage_c1'
             ELSE 'train/' || replace(camera_id, ',', '%2C') || '.' || video_id || '_frame_' || lpad(CAST(frames_count AS VARCHAR), 5, '0') || '_cage_c1' END AS crop,
           'train/' || replace(camera_id, ',', '%2C') || '/' || video_id || '/s/' || lpad(CAST(frames_count AS VARCHAR), 5, '0') || '.jpg' AS square,
           video_id || '_c1_clip' || lpad(CAST(frames_count AS VARCHAR), 3, '0') AS clip,
           regexp_replace(video_path, '_\\d+$', '') AS stem, string_split(replace(string_split(video_path, '/')[-2], '%2C', ','), '.')[1] AS camera,
           '20210304_050607' AS run
    FROM a1""".replace("\\\\", "\\"), "a1")
def output_paths(spark, d):
    c = F.col
    split = F.when(c("frames_count") % 2 == 0, "test").otherwise("train")
    return adapter(spark, d, "a1").select(
        "video_id", sinks.crop_path(split, c("camera_id"), c("video_id"), F.lit("c1"), c("frames_count")).alias("crop"),
        sinks.square_path(c("camera_id"), c("video_id"), F.lit("s"), c("frames_count")).alias("square"),
        paths.clip_name(c("video_id"), c("frames_count"), F.lit("c1")).alias("clip"),
        paths.without_ordinal(F.concat("video_path", F.when(c("frames_count") % 2 == 0, "_12").otherwise(""))).alias("stem"),
        paths.camera_stem(c("video_path")).alias("camera"), paths.run_id(F.to_timestamp(F.lit("2021-03-04 05:06:07"))).alias("run"))
