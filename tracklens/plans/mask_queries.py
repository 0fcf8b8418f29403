"""Queries of the box, mask and evaluation operators, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions import boxes as box
from tracklens.functions.numbers import frames_between
from tracklens.operators import boxes, evaluation, masks, scoring
from tracklens.plans.adapters import adapter, oracle, table

SIDE, THRESHOLD = 8, 0.25
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str, *views: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


def _objects(spark, d, above: float = 0.0) -> DataFrame:
    """The 8 x 8 masks of A4 as nested boolean lists."""
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(SIDE - 1)),
        lambda y: F.transform(F.slice("embedding", y * SIDE + 1, SIDE), lambda v: v > F.lit(above).cast("float")))
    return adapter(spark, d, "a4").withColumn("mask", rows).drop("embedding")


def _runs(spark, d, above: float = 0.0) -> DataFrame:
    return masks.mask_runs(_objects(spark, d, above))


_CELLS = """
    cells AS (SELECT video_id, frame, cage_id, i, i // 8 AS y, i % 8 AS x, v > 0 AS lit
              FROM (SELECT video_id, frame, cage_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM a4)),
    fr AS (SELECT video_id, frame, lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS prev
           FROM (SELECT DISTINCT video_id, frame FROM a4)),
    ious AS (SELECT c.video_id, c.frame, c.cage_id, CAST(sum(CASE WHEN c.lit AND p.lit THEN 1 ELSE 0 END) AS BIGINT) AS common,
                    CAST(sum(CASE WHEN c.lit OR p.lit THEN 1 ELSE 0 END) AS BIGINT) AS united
             FROM cells c JOIN fr ON fr.video_id = c.video_id AND fr.frame = c.frame
             JOIN cells p ON p.video_id = c.video_id AND p.frame = fr.prev AND p.cage_id = c.cage_id AND p.i = c.i
             GROUP BY c.video_id, c.frame, c.cage_id)"""
_SEGMENTS = _CELLS + """,
    m AS (SELECT video_id, frame, min(CASE WHEN united > 0 THEN CAST(common AS DOUBLE) / united END) AS low, count(*) AS n FROM ious GROUP BY video_id, frame),
    b AS (SELECT fr.video_id, fr.frame, prev IS NULL OR n IS NULL OR coalesce(low < 0.25, false) AS is_start
          FROM fr LEFT JOIN m ON m.video_id = fr.video_id AND m.frame = fr.frame),
    segs AS (SELECT video_id, row_number() OVER w - 1 AS segment_idx, frame AS start,
                    coalesce(lead(frame) OVER w - 1, (SELECT max(frame) FROM fr f WHERE f.video_id = b.video_id)) AS "end"
             FROM b WHERE is_start WINDOW w AS (PARTITION BY video_id ORDER BY frame))"""


@query("mask_iou", _CELLS + """
    SELECT video_id, frame, cage_id, common, united, CASE WHEN united > 0 THEN CAST(common AS DOUBLE) / united END AS iou FROM ious""", "a4")
def mask_iou(spark, d):
    return masks.frame_ious(_objects(spark, d), _runs(spark, d), ["video_id"])


def _segments(spark, d) -> DataFrame:
    bounds = masks.segment_boundaries(_objects(spark, d), _runs(spark, d), ["video_id"], THRESHOLD)
    return masks.segments_of(bounds, ["video_id"])


@query("segment_boundaries", _SEGMENTS + ' SELECT video_id, segment_idx, start, "end" FROM segs', "a4")
def segment_boundaries(spark, d):
    return _segments(spark, d)


_ASKED = """,
    asked AS (SELECT video_id, unnest(range(0, CAST(max(frame) + 4 AS BIGINT))) AS frame FROM a4 GROUP BY video_id),
    looked AS (SELECT a.video_id, a.frame, coalesce(min(s.segment_idx), (SELECT max(segment_idx) FROM segs z WHERE z.video_id = a.video_id)) AS segment_idx
               FROM asked a LEFT JOIN segs s ON s.video_id = a.video_id AND a.frame BETWEEN s.start AND s."end" GROUP BY a.video_id, a.frame)"""


def _asked(spark, d) -> DataFrame:
    return adapter(spark, d, "a4").groupBy("video_id").agg(F.max("frame").alias("m")).select(
        "video_id", F.explode(frames_between(F.lit(0), F.col("m") + 3)).alias("frame"))


@query("segment_lookup", _SEGMENTS + _ASKED + " SELECT video_id, frame, segment_idx FROM looked", "a4")
def segment_lookup(spark, d):
    return masks.segment_lookup(_asked(spark, d), _segments(spark, d), ["video_id"])


_TRACKS = """
    SELECT DISTINCT CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS track_id,
      CAST(l_orderkey % 5 AS BIGINT) AS video_id, CAST(2 + l_partkey % 25 AS BIGINT) AS frame_begin,
      CAST(l_partkey % 100 AS DOUBLE) / 100 AS mean_x, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS mean_y
    FROM {lineitem}"""


def _located(spark, d):
    segments = _segments(spark, d)
    runs = masks.keyframe_masks(_runs(spark, d), segments, ["video_id"]).withColumn("cage_ord", F.expr("cast(substring(cage_id, 2) as int)"))
    return spark.sql(_TRACKS, lineitem=table(spark, d, "lineitem")), segments, runs


ASSIGNED = _SEGMENTS + f""",
    t AS ({_TRACKS.replace('{', '').replace('}', '')}),
    ref AS (SELECT video_id, min(frame_begin) AS frame FROM t GROUP BY video_id),
    used AS (SELECT r.video_id, coalesce(min(s.segment_idx), (SELECT max(segment_idx) FROM segs z WHERE z.video_id = r.video_id)) AS segment_idx
           FROM ref r LEFT JOIN segs s ON s.video_id = r.video_id AND r.frame BETWEEN s.start AND s."end" GROUP BY r.video_id),
    key AS (SELECT c.* FROM used u JOIN segs s ON s.video_id = u.video_id AND s.segment_idx = u.segment_idx
            JOIN cells c ON c.video_id = s.video_id AND c.frame = s.start WHERE lit)
    SELECT t.track_id, t.video_id, min(cage_id) AS cage_id
    FROM t JOIN key ON key.video_id = t.video_id AND key.y = CAST(trunc(least(7, greatest(0, mean_y * 8))) AS BIGINT)
         AND key.x = CAST(trunc(least(7, greatest(0, mean_x * 8))) AS BIGINT)
    GROUP BY t.track_id, t.video_id"""


@query("assign_cage", ASSIGNED, "a4")
def assign_cage(spark, d):
    tracks, segments, runs = _located(spark, d)
    return masks.assign_cages(tracks, segments, runs, SIDE, SIDE, ["video_id"]).select("track_id", "video_id", "cage_id")


@query("mask_bbox", _CELLS + """
    SELECT video_id, frame, cage_id, CAST(greatest(0, min(x) - 1) AS BIGINT) AS x_min, CAST(greatest(0, min(y) - 1) AS BIGINT) AS y_min,
           CAST(least(7, max(x) + 1) AS BIGINT) AS x_max, CAST(least(7, max(y) + 1) AS BIGINT) AS y_max FROM cells WHERE lit GROUP BY video_id, frame, cage_id""", "a4")
def mask_bbox(spark, d):
    return masks.mask_boxes(_runs(spark, d), ["video_id", "frame", "cage_id"], SIDE, SIDE, padding=1)


@query("segment_crops", _SEGMENTS + _ASKED + """,
    bb AS (SELECT c.video_id, s.segment_idx, c.cage_id, CAST(min(x) AS BIGINT) AS x_min, CAST(min(y) AS BIGINT) AS y_min, CAST(max(x) AS BIGINT) AS x_max, CAST(max(y) AS BIGINT) AS y_max
           FROM cells c JOIN segs s ON s.video_id = c.video_id AND s.start = c.frame WHERE lit GROUP BY c.video_id, s.segment_idx, c.cage_id)
    SELECT l.video_id, l.frame, l.segment_idx, cage_id, x_min, y_min, x_max, y_max
    FROM looked l JOIN bb ON bb.video_id = l.video_id AND bb.segment_idx = l.segment_idx""", "a4")
def segment_crops(spark, d):
    segments = _segments(spark, d)
    frames = _asked(spark, d).groupBy("video_id").agg(F.collect_list("frame").alias("target_frames"))
    held = masks.mask_boxes(masks.keyframe_masks(_runs(spark, d), segments, ["video_id"]), ["video_id", "segment_idx", "cage_id"], SIDE, SIDE)
    return masks.plan_all_cages(frames, segments, held, ["video_id"])


@query("mask_eval", """
    bth AS (SELECT video_id, frame, cage_id, CAST(sum(CASE WHEN v > 0 AND v > CAST(0.05 AS FLOAT) THEN 1 ELSE 0 END) AS BIGINT) AS common,
                    CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS united
             FROM (SELECT video_id, frame, cage_id, unnest(embedding) AS v FROM a4) GROUP BY video_id, frame, cage_id)
    SELECT *, CASE WHEN united > 0 THEN CAST(common AS DOUBLE) / united END AS iou FROM bth""", "a4")
def mask_eval(spark, d):
    keys = ["video_id", "frame", "cage_id"]
    return evaluation.evaluate_masks(_objects(spark, d), _runs(spark, d), _objects(spark, d, 0.05), _runs(spark, d, 0.05), keys)


@query("iou_histogram", _CELLS + """
    SELECT CAST(least(50, floor(CAST(common AS DOUBLE) / united * 50) + 1) AS BIGINT) AS bin, count(*) AS n FROM ious WHERE united > 0 GROUP BY 1""", "a4")
def iou_histogram(spark, d):
    return evaluation.unit_histogram(mask_iou(spark, d), "iou")


@query("worst_iou", _CELLS + """,
    low AS (SELECT video_id, frame, cage_id, CAST(common AS DOUBLE) / united AS iou FROM ious WHERE united > 0 ORDER BY iou, video_id, frame, cage_id LIMIT 100)
    SELECT video_id, frame, cage_id, iou FROM low
    QUALIFY row_number() OVER (PARTITION BY video_id, cage_id ORDER BY iou, video_id, frame, cage_id) = 1""", "a4")
def worst_iou(spark, d):
    rows = mask_iou(spark, d).select("video_id", "frame", "cage_id", "iou")
    return evaluation.lowest(rows, "iou", 100, ["video_id", "cage_id"], ["video_id", "frame", "cage_id"])


_W, _H = 160, 120


def _lines(spark, d) -> DataFrame:
    """Ground-truth boxes of A5 as label lines of a 160 x 120 image."""
    return adapter(spark, d, "a5").filter("has_gt").select(
        "video_id", "frame", F.col("cage_id").alias("line_no"), F.lit(0).alias("class_id"),
        ((F.col("gt_left") + F.col("w") / 2) / _W).alias("xc"), ((F.col("gt_top") + F.col("h") / 2) / _H).alias("yc"),
        (F.col("w") / _W).alias("w"), (F.col("h") / _H).alias("h"))


_LINES = """
    lines AS (SELECT video_id, frame, cage_id AS line_no, (gt_left + w / 2) / 160 AS xc, (gt_top + h / 2) / 120 AS yc, w / 160 AS w, h / 120 AS h FROM a5 WHERE has_gt)"""


@query("box_convert", """
    c AS (SELECT track_id, frame, (x + width / 2) / 100 AS xc, (y + height / 2) / 100 AS yc, width / 100 AS w, height / 100 AS h FROM a3)
    SELECT track_id, frame, xc, yc, w, h, (xc - w / 2) * 1920 AS "left", (yc - h / 2) * 1080 AS top, w * 1920 AS w_px, h * 1080 AS h_px,
           xc * 1920 - 0.5::DOUBLE * w * 1920 AS x0, yc * 1080 - 0.5::DOUBLE * h * 1080 AS y0,
           xc * 1920 + 0.5::DOUBLE * w * 1920 AS x1, yc * 1080 + 0.5::DOUBLE * h * 1080 AS y1,
           greatest(0, CAST(trunc((xc - w / 2) * 1920) AS BIGINT)) AS px1, greatest(0, CAST(trunc((yc - h / 2) * 1080) AS BIGINT)) AS py1,
           least(1919, CAST(trunc((xc + w / 2) * 1920) AS BIGINT)) AS px2, least(1079, CAST(trunc((yc + h / 2) * 1080) AS BIGINT)) AS py2
    FROM c""", "a3")
def box_convert(spark, d):
    made = box.percent_corner_to_center(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    rows = adapter(spark, d, "a3").select(
        "track_id", "frame", made["xc"].alias("xc"), made["yc"].alias("yc"), made["wn"].alias("w"), made["hn"].alias("h"))
    own = [F.col(c) for c in ("xc", "yc", "w", "h")]
    return rows.withColumns(
        box.center_to_pixels(*own, 1920, 1080) | box.center_to_corners(*own, 1920, 1080) | box.pixel_corners(*own, 1920, 1080))


@query("crop_labels", _LINES + """,
    r AS (SELECT *, CAST(video_id * 2 AS DOUBLE) AS x_min, CAST(frame % 11 AS DOUBLE) AS y_min, CAST(video_id * 2 + 70 AS DOUBLE) AS x_max, CAST(frame % 11 + 50 AS DOUBLE) AS y_max FROM lines),
    k AS (SELECT video_id, frame, line_no, (xc * 160 - x_min) / (x_max - x_min) AS cxc, (yc * 120 - y_min) / (y_max - y_min) AS cyc,
                 w * 160 / (x_max - x_min) AS cw, h * 120 / (y_max - y_min) AS ch FROM r)
    SELECT * FROM k WHERE cxc BETWEEN 0 AND 1 AND cyc BETWEEN 0 AND 1""", "a5")
def crop_labels(spark, d):
    lines = _lines(spark, d)
    crops = lines.select("video_id", "frame").distinct().select(
        "video_id", "frame", F.lit(float(_W)).alias("img_w"), F.lit(float(_H)).alias("img_h"), (F.col("video_id") * 2).cast("double").alias("x_min"),
        (F.col("frame") % 11).cast("double").alias("y_min"), (F.col("video_id") * 2 + 70).cast("double").alias("x_max"),
        (F.col("frame") % 11 + 50).cast("double").alias("y_max"))
    return boxes.crop_labels(lines, crops, ["video_id", "frame"]).select("video_id", "frame", "line_no", "cxc", "cyc", "cw", "ch")


@query("square_crop", _LINES + """,
    p AS (SELECT *, CAST(trunc(xc * 160) AS BIGINT) AS px, CAST(trunc(yc * 120) AS BIGINT) AS py, count(*) OVER (PARTITION BY video_id, frame) AS n FROM lines)
    SELECT video_id, frame, line_no, greatest(0, px - 32) AS sx1, greatest(0, py - 32) AS sy1, least(160, px + 32) AS sx2, least(120, py + 32) AS sy2,
           greatest(0, 32 - px) AS pad_left, greatest(0, 32 - py) AS pad_top, greatest(0, px + 32 - 160) AS pad_right, greatest(0, py + 32 - 120) AS pad_bottom,
           CASE WHEN n > 1 THEN '_bird_' || CAST(line_no AS VARCHAR) ELSE '' END AS suffix FROM p""", "a5")
def square_crop(spark, d):
    return boxes.square_crops(_lines(spark, d), ["video_id", "frame"], _W, _H, 64).drop("class_id", "xc", "yc", "w", "h")


@query("box_lines", """
    asked AS (SELECT DISTINCT track_id, unnest(range(1, 98, 4)) AS frame FROM a3),
    shown AS (SELECT *, CAST(trunc(frame * CAST(25 AS DOUBLE) / CAST(30 AS DOUBLE)) AS BIGINT) AS f FROM asked)
    SELECT s.track_id, s.frame, CASE WHEN x IS NOT NULL THEN 0 END AS class_id, (x + width / 2) / 100 AS xc, (y + height / 2) / 100 AS yc, width / 100 AS w, height / 100 AS h
    FROM shown s LEFT JOIN a3 ON a3.track_id = s.track_id AND a3.frame = s.f""", "a3")
def box_lines(spark, d):
    keyframes = adapter(spark, d, "a3")
    targets = keyframes.select("track_id").distinct().select(
        "track_id", F.explode(F.sequence(F.lit(1), F.lit(97), F.lit(4)).cast("array<bigint>")).alias("frame"), F.lit(25.0).alias("ls_fps"), F.lit(30.0).alias("fps"))
    return boxes.box_lines(targets, keyframes, ["track_id"])


@query("mot_rows", _LINES + """
    SELECT video_id, frame, 1 AS id, (xc - w / 2) * 160 AS "left", (yc - h / 2) * 120 AS top, w * 160 AS w, h * 120 AS h, 1.0::DOUBLE AS conf FROM lines""", "a5")
def mot_rows(spark, d):
    lines = _lines(spark, d)
    sizes = lines.select("video_id").distinct().select(
        "video_id", F.lit(None).cast("bigint").alias("frame"), F.lit(_W).alias("width"), F.lit(_H).alias("height"))
    return evaluation.mot_rows(lines, sizes, ["video_id"])


_BY = ["video_id", "cage_id"]
_MATCHED = """
    g AS (SELECT video_id, cage_id, frame, has_gt, has_pred, CASE WHEN has_pred THEN pred_id END AS pred_id,
            CASE WHEN has_gt AND has_pred THEN greatest(0, least(gt_left + w, pred_left + w) - greatest(gt_left, pred_left))
                 * greatest(0, least(gt_top + h, pred_top + h) - greatest(gt_top, pred_top)) END AS overlap, w * h AS area
          FROM a5 WHERE has_gt OR has_pred),
    m AS (SELECT *, overlap / (area + area - overlap) AS iou, coalesce(overlap / (area + area - overlap) >= 0.5, false) AS hit FROM g)"""


@query("box_matches", _MATCHED + " SELECT video_id, cage_id, frame, has_gt AS has_t, has_pred AS has_p, pred_id, iou, hit FROM m", "a5")
def box_matches(spark, d):
    return evaluation.match_boxes(*_boxes(spark, d), _BY)


def _boxes(spark, d, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    rows = adapter(spark, d, "a5") if rows is None else rows
    truth = rows.filter("has_gt").select(*_BY, "frame", F.col("gt_left").alias("left"), F.col("gt_top").alias("top"), "w", "h")
    predictions = rows.filter("has_pred").select(*_BY, "frame", "pred_id", F.col("pred_left").alias("left"), F.col("pred_top").alias("top"), "w", "h")
    return truth, predictions


@query("tracking_metrics", _MATCHED + """,
    x AS (SELECT *, last_value(CASE WHEN hit THEN pred_id END IGNORE NULLS) OVER e AS last_id,
                 last_value(CASE WHEN has_gt THEN hit END IGNORE NULLS) OVER e AS was_hit,
                 max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, cage_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
          FROM m WINDOW e AS (PARTITION BY video_id, cage_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT video_id, cage_id, count(DISTINCT frame) AS num_frames, count(*) FILTER (has_gt) AS num_objects, count(*) FILTER (has_pred) AS num_predictions,
                 count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND last_id <> pred_id) AS num_switches,
                 count(*) FILTER (has_gt AND NOT hit AND was_hit AND later = 1) AS num_fragmentations, sum(1 - iou) FILTER (hit) AS dist
          FROM x GROUP BY video_id, cage_id),
    t AS (SELECT video_id, cage_id, max(n) AS idtp FROM (SELECT video_id, cage_id, pred_id, count(*) AS n FROM m WHERE hit GROUP BY ALL) GROUP BY video_id, cage_id),
    j AS (SELECT s.*, coalesce(idtp, 0) AS idtp FROM s LEFT JOIN t USING (video_id, cage_id))
    SELECT video_id, cage_id, num_frames, num_objects, num_predictions, num_objects - hits AS num_misses, num_predictions - hits AS num_false_positives,
           num_switches, num_fragmentations,
           CASE WHEN num_objects > 0 AND CAST(hits AS DOUBLE) / num_objects >= CAST(0.8 AS DOUBLE) THEN 1 ELSE 0 END AS mostly_tracked,
           CASE WHEN num_objects > 0 AND CAST(hits AS DOUBLE) / num_objects >= CAST(0.2 AS DOUBLE) AND CAST(hits AS DOUBLE) / num_objects < CAST(0.8 AS DOUBLE) THEN 1 ELSE 0 END AS partially_tracked,
           CASE WHEN num_objects > 0 AND CAST(hits AS DOUBLE) / num_objects < CAST(0.2 AS DOUBLE) THEN 1 ELSE 0 END AS mostly_lost,
           CASE WHEN num_predictions > 0 THEN CAST(hits AS DOUBLE) / num_predictions END AS precision,
           CASE WHEN num_objects > 0 THEN CAST(hits AS DOUBLE) / num_objects END AS recall,
           CASE WHEN num_objects > 0 THEN 1 - CAST(num_objects - hits + num_predictions - hits + num_switches AS DOUBLE) / num_objects END AS mota,
           round(CASE WHEN hits > 0 THEN dist / hits END, 6) AS motp,
           CASE WHEN num_predictions > 0 THEN CAST(idtp AS DOUBLE) / num_predictions END AS idp, CASE WHEN num_objects > 0 THEN CAST(idtp AS DOUBLE) / num_objects END AS idr,
           CAST(2 * idtp AS DOUBLE) / (num_objects + num_predictions) AS idf1
    FROM j""", "a5")
def tracking_metrics(spark, d):
    return evaluation.tracking_metrics(*_boxes(spark, d), _BY, crowded=False).withColumn("motp", F.round("motp", 6))


def _scored(spark, d) -> DataFrame:
    rows = adapter(spark, d, "a6").withColumn("logits", F.slice("embedding", 1, 10))
    return rows.select("vec_id", F.col("true_class").cast("bigint").alias("true_class"), scoring.predicted_class(F.col("logits")).alias("pred_class"))


_PAIRS = """
    p AS (SELECT vec_id, CAST(true_class AS BIGINT) AS true_class, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS BIGINT) AS pred_class FROM a6)"""


@query("argmax_prediction", _PAIRS + " SELECT * FROM p", "a6")
def argmax_prediction(spark, d):
    return _scored(spark, d)


def _linear_model():
    """Ten classes: twice the own feature less the next one, and a bias."""
    own = np.eye(10)
    weights, bias = 2 * own - np.roll(own, 1, axis=1), np.arange(1, 11) % 3 / 8
    return lambda batch: np.asarray(batch, dtype=np.float64) @ weights.T + bias


@query("batch_score", """
    x AS (SELECT vec_id, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS x FROM a6),
    s AS (SELECT vec_id, list_transform(range(1, 11), lambda k: 2 * x[k] - x[k % 10 + 1] + CAST(k % 3 AS DOUBLE) / 8) AS logits FROM x)
    SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS pred_class FROM s""", "a6")
def batch_score(spark, d):
    rows = adapter(spark, d, "a6").withColumn("x", F.slice("embedding", 1, 10).cast("array<double>"))
    return scoring.score(rows, "x", _linear_model, 10).select("vec_id", scoring.predicted_class(F.col("logits")).alias("pred_class"))


@query("confusion_matrix", _PAIRS + """,
    l AS (SELECT true_class AS label FROM p UNION SELECT pred_class FROM p)
    SELECT a.label AS true_class, b.label AS pred_class, count(p.vec_id) AS n
    FROM l a CROSS JOIN l b LEFT JOIN p ON p.true_class = a.label AND p.pred_class = b.label GROUP BY a.label, b.label""", "a6")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_scored(spark, d))


@query("classification_report", _PAIRS + """,
    l AS (SELECT true_class AS label FROM p UNION SELECT pred_class FROM p),
    s AS (SELECT label, count(*) FILTER (true_class = label) AS support, count(*) FILTER (pred_class = label) AS predicted,
                 count(*) FILTER (true_class = label AND pred_class = label) AS tp FROM l JOIN p ON true_class = label OR pred_class = label GROUP BY label),
    r AS (SELECT CAST(label AS VARCHAR) AS label, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
                 CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall, CAST(2 * tp AS DOUBLE) / (support + predicted) AS f1, support, tp FROM s),
    o AS (SELECT label, precision, recall, f1, support FROM r
          UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM r
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM o""", "a6")
def classification_report(spark, d):
    return evaluation.classification_report(_scored(spark, d)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("accuracy", _PAIRS + " SELECT avg(CASE WHEN true_class = pred_class THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM p", "a6")
def accuracy(spark, d):
    return evaluation.accuracy(_scored(spark, d))


@query("label_codes", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_code FROM (SELECT DISTINCT label FROM a2)", "a2")
def label_codes(spark, d):
    return scoring.label_codes(adapter(spark, d, "a2"))


def _log(spark, d) -> DataFrame:
    return adapter(spark, d, "a7").groupBy("run_id", "epoch").agg(
        F.round(F.avg("loss"), 6).alias("mean_loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n_batches"))


_LOG = """
    e AS (SELECT run_id, epoch, round(avg(loss), 6) AS mean_loss, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS n_batches FROM a7 GROUP BY run_id, epoch)"""


@query("epoch_loss", _LOG + " SELECT run_id, epoch, mean_loss, n_batches FROM e", "a7")
def epoch_loss(spark, d):
    return evaluation.epoch_loss(adapter(spark, d, "a7"), ["run_id"]).withColumn("mean_loss", F.round("mean_loss", 6))


@query("best_epoch", _LOG + """
    SELECT run_id, first(epoch ORDER BY mean_loss, epoch) AS best_loss_epoch, first(epoch ORDER BY accuracy DESC, epoch DESC) AS best_score_epoch FROM e GROUP BY run_id""", "a7")
def best_epoch(spark, d):
    return evaluation.best_epochs(_log(spark, d), ["run_id"])


@query("running_best", _LOG + """,
    b AS (SELECT run_id, epoch, mean_loss, min(mean_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e)
    SELECT *, best_before IS NULL OR mean_loss < best_before AS improved FROM b""", "a7")
def running_best(spark, d):
    return evaluation.running_best(_log(spark, d), ["run_id"]).select("run_id", "epoch", "mean_loss", "best_before", "improved")


@query("renumbered_frames", """
    f AS (SELECT DISTINCT video_id, frame FROM a4), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 2 AS ordinal FROM f)
    SELECT * FROM n WHERE ordinal >= 0""", "a4")
def renumbered_frames(spark, d):
    return masks.renumbered(adapter(spark, d, "a4").select("video_id", "frame").distinct(), ["video_id"])


@query("label_files", _LINES + """
    SELECT video_id, frame, count(*) AS n_lines, round(sum(CAST(printf('%.6f', xc) AS DOUBLE)), 6) AS sum_xc FROM lines GROUP BY video_id, frame""", "a5")
def label_files(spark, d):
    """Makes label bodies and parses them again: what is returned are the lines and coordinates of the text form."""
    from tracklens.sources.sinks import box_label_files

    lines = _lines(spark, d)
    files = box_label_files(lines, lines, ["video_id", "frame"])
    back = files.select("video_id", "frame", F.explode(F.split("body", "\n")).alias("l")).withColumn("v", box.parse_line(F.col("l"), 5))
    return back.groupBy("video_id", "frame").agg(F.count("v").alias("n_lines"), F.round(F.sum(F.col("v")[1]), 6).alias("sum_xc"))
