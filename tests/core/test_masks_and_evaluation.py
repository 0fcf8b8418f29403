import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tracklens.operators import boxes, evaluation, images, masks, scoring

BOX = "video_id bigint, cage_id bigint, frame bigint, left double, top double, w double, h double"


def runs_of(spark, rows):
    objects = spark.createDataFrame(rows, "video_id bigint, frame bigint, cage_id string, mask array<array<boolean>>")
    return objects, masks.mask_runs(objects)


def test_runs_area_and_iou_match_numpy(spark):
    rng = np.random.default_rng(1)
    made = [(1, f, c, (rng.random((5, 6)) > 0.5)) for f in range(3) for c in ("a", "b")] + [(1, f, "e", np.zeros((5, 6), bool)) for f in range(3)]
    objects, runs = runs_of(spark, [(v, f, c, m.tolist()) for v, f, c, m in made])
    by = {(f, c): m for _, f, c, m in made}
    areas = {(r.frame, r.cage_id): r.area for r in masks.mask_areas(objects, runs, ["frame", "cage_id"]).collect()}
    assert areas == {k: int(m.sum()) for k, m in by.items()}
    for r in masks.frame_ious(objects, runs, ["video_id"]).collect():
        a, b = by[r.frame, r.cage_id], by[r.frame - 1, r.cage_id]
        assert (r.common, r.united) == ((a & b).sum(), (a | b).sum())
        assert (r.iou is None) == (not (a | b).any())
    other = F.lit(None).cast("array<array<boolean>>")
    assert objects.select(masks.mask_iou_arrays(F.col("mask"), F.col("mask")).alias("i")).filter("i is not null and i <> 1").count() == 0
    assert objects.select(masks.mask_iou_arrays(F.col("mask"), other).alias("i")).filter("i is not null").count() == 0


def test_segments_partition_the_frames_and_lookup_falls_back_to_the_last(spark):
    full, half, none = [[True] * 4], [[True, True, False, False]], [[False] * 4]
    objects, runs = runs_of(spark, [(1, 0, "a", full), (1, 1, "a", full), (1, 2, "a", half), (1, 3, "a", half), (1, 4, "b", half), (1, 5, "b", none)])
    bounds = masks.segment_boundaries(objects, runs, ["video_id"], 0.9)
    got = [tuple(r) for r in masks.segments_of(bounds, ["video_id"]).select("segment_idx", "start", "end").orderBy("segment_idx").collect()]
    assert got == [(0, 0, 1), (1, 2, 3), (2, 4, 4), (3, 5, 5)]
    frames = spark.createDataFrame([(1, f) for f in (0, 1, 3, 4, 99)] + [(2, 0)], "video_id bigint, frame bigint")
    looked = {r.frame: r.segment_idx for r in masks.segment_lookup(frames, masks.segments_of(bounds, ["video_id"]), ["video_id"]).collect()}
    assert looked == {0: 0, 1: 0, 3: 1, 4: 2, 99: 3}


def test_first_cage_that_holds_the_point_wins(spark):
    runs = spark.createDataFrame([(1, 0, "z", 0, 0, 0, 3), (1, 0, "a", 1, 0, 0, 3), (1, 0, "a", 1, 1, 2, 3)], "video_id bigint, segment_idx bigint, cage_id string, cage_ord int, y int, x0 int, x1 int")
    segments = spark.createDataFrame([(1, 0, 1, 9)], "video_id bigint, segment_idx bigint, start bigint, end bigint")
    index = spark.createDataFrame([(1, "p", 2, 0.1, 0.1), (1, "q", 3, 1.5, 0.9), (1, "none", 3, 0.0, 0.9)], "video_id bigint, track_id string, frame_begin bigint, mean_x double, mean_y double")
    got = {r.track_id: r.cage_id for r in masks.assign_cages(index, segments, runs, 2, 4, ["video_id"]).collect()}
    assert got == {"p": "z", "q": "a"}


def test_crop_labels_keep_edges_and_drop_outside(spark):
    lines = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.4, 0.4), (1, 1, 0.9, 0.5, 0.1, 0.1), (1, 2, 0.25, 0.25, 0.1, 0.1)], "k bigint, line_no bigint, xc double, yc double, w double, h double")
    crops = spark.createDataFrame([(1, 200.0, 200.0, 50.0, 50.0, 150.0, 150.0)], "k bigint, img_w double, img_h double, x_min double, y_min double, x_max double, y_max double")
    kept = boxes.crop_labels(lines, crops, ["k"])
    assert {r.line_no: (r.cxc, r.cyc, round(r.cw, 9)) for r in kept.collect()} == {0: (0.5, 0.5, 0.8), 2: (0.0, 0.0, 0.2)}
    assert boxes.winning_line(kept, ["k"]).first().line_no == 2


def test_tracking_metrics_of_one_animal(spark):
    truth = spark.createDataFrame([(1, 1, f, 0.0, 0.0, 10.0, 10.0) for f in range(6)], BOX)
    # hit by 1, hit by 2 (switch), missed with a far box, missed, hit by 2; frame 6 has a prediction alone
    rows = [(0, 1, 0.0), (1, 2, 1.0), (2, 2, 50.0), (4, 2, 0.0), (6, 2, 0.0)]
    predictions = spark.createDataFrame([(1, 1, f, i, x, 0.0, 10.0, 10.0) for f, i, x in rows], BOX.replace("frame bigint,", "frame bigint, pred_id bigint,"))
    r = evaluation.tracking_metrics(truth, predictions, ["video_id", "cage_id"]).first()
    assert (r.num_frames, r.num_objects, r.num_misses, r.num_false_positives, r.num_switches, r.num_fragmentations) == (7, 6, 3, 2, 1, 1)
    assert (r.mostly_tracked, r.partially_tracked, r.mostly_lost) == (0, 1, 0)
    assert r.precision == 0.6 and r.recall == 0.5 and abs(r.mota) < 1e-12 and r.idr == 2 / 6
    assert abs(r.motp - (1 - 90 / 110) / 3) < 1e-12


def test_general_path_agrees_with_the_simple_one(spark):
    rng = random.Random(4)
    truth = [(1, 1, f, 0.0, 0.0, 10.0, 10.0) for f in range(30) if rng.random() < 0.9]
    pred = [(1, 1, f, rng.randint(1, 2), rng.choice((0.0, 2.0, 40.0)), 0.0, 10.0, 10.0) for f in range(30) if rng.random() < 0.9]
    t, p = spark.createDataFrame(truth, BOX), spark.createDataFrame(pred, BOX.replace("frame bigint,", "frame bigint, pred_id bigint,"))
    simple = evaluation.tracking_metrics(t, p, ["video_id", "cage_id"]).first().asDict()
    # one frame with two predictions makes the sequence general; the extra one is a false positive
    extra = spark.createDataFrame([(1, 1, pred[0][2], 9, 500.0, 0.0, 10.0, 10.0)], p.schema)
    general = evaluation.tracking_metrics(t, p.unionByName(extra), ["video_id", "cage_id"]).first().asDict()
    for m in ("num_objects", "num_misses", "num_switches", "num_fragmentations", "mostly_tracked", "recall", "idr"):
        assert general[m] == simple[m], m
    assert general["num_false_positives"] == simple["num_false_positives"] + 1


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 3), (3, 2), (4, 4), (5, 3), (0, 3)):
        cost = rng.random((n, m))
        pairs = evaluation.least_cost_pairs(cost)
        k = min(n, m)
        assert len(pairs) == k and len({i for i, _ in pairs}) == k and len({j for _, j in pairs}) == k
        small = cost if n <= m else cost.T
        best = min((sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), k)), default=0)
        assert abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_report_with_a_class_never_predicted(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "true_class bigint, pred_class bigint")
    got = {r.label: r for r in evaluation.classification_report(pairs).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"].f1 == 0.75 and abs(got["macro avg"].precision - (2 / 3 + 0 + 1) / 3) < 1e-12
    assert evaluation.confusion_matrix(pairs).filter("n = 0").count() == 6


def test_best_epochs_break_ties(spark):
    log = spark.createDataFrame([(1, 1, 0.5, 0.9), (1, 2, 0.5, 0.9), (1, 3, 0.7, 0.1)], "run_id bigint, epoch bigint, mean_loss double, accuracy double")
    r = evaluation.best_epochs(log, ["run_id"]).first()
    assert (r.best_loss_epoch, r.best_score_epoch) == (1, 2)
    assert [x.improved for x in evaluation.running_best(log, ["run_id"]).orderBy("epoch").collect()] == [True, False, False]


def test_histogram_puts_one_in_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (None,)], "iou double")
    assert dict(evaluation.unit_histogram(rows, "iou", 50).collect()) == {1: 1, 50: 2}


def test_pixel_crops(spark):
    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    row = [("o", 4, 5, 3, 16, bytearray(pixels.tobytes()))]
    image = spark.createDataFrame(row, images.IMAGE)
    boxed = image.withColumns({"x_min": F.lit(1), "y_min": F.lit(1), "x_max": F.lit(2), "y_max": F.lit(2),
                               "runs": F.array(F.struct(F.lit(1).alias("y"), F.lit(1).alias("x0"), F.lit(1).alias("x1")))})
    got = images.crop_images_mask(boxed).first()
    cut = np.frombuffer(bytes(got.data), np.uint8).reshape(got.height, got.width, 3)
    assert cut.shape == (2, 2, 3) and (cut[0, 0] == pixels[1, 1]).all() and cut[0, 1].sum() == 0 and cut[1].sum() == 0
    square = image.withColumns({k: F.lit(v) for k, v in dict(sx1=0, sy1=0, sx2=2, sy2=2, pad_left=2, pad_top=1, pad_right=0, pad_bottom=1).items()})
    got = images.crop_images_square(square).first()
    cut = np.frombuffer(bytes(got.data), np.uint8).reshape(got.height, got.width, 3)
    assert cut.shape == (4, 4, 3) and (cut[1:3, 2:] == pixels[:2, :2]).all() and cut[0].sum() == 0


def test_label_codes_are_fitted_once(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    codes = scoring.label_codes(train)
    got = {r.label: r.label_code for r in scoring.encode_labels(spark.createDataFrame([("b",), ("z",)], "label string"), codes).collect()}
    assert got == {"b": 1, "z": None}
