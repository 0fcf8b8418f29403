"""Evaluation: tracking metrics, mask overlap, classification reports, training logs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.boxes import box_iou
from tracklens.functions.numbers import ratio
from tracklens.operators.masks import mask_iou

METRICS = [
    "num_frames", "num_objects", "num_predictions", "num_misses", "num_false_positives", "num_switches", "num_fragmentations",
    "mostly_tracked", "partially_tracked", "mostly_lost", "precision", "recall", "mota", "motp", "idp", "idr", "idf1",
]
GENERAL_SCHEMA = ", ".join(f"{m} {'double' if m in METRICS[10:] else 'bigint'}" for m in METRICS)


#: What a caller does with a table that is read several times.
Keep = Callable[[DataFrame, str], DataFrame]


def as_is(table: DataFrame, name: str) -> DataFrame:
    return table


def mot_rows(lines: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Label lines as pixel boxes ``by, frame, id, left, top, w, h, conf``.

    ``lines`` holds normalised centre boxes (and ``track_id``, ``conf`` for predictions; true boxes have id 1 and confidence 1);
    ``sizes`` image sizes ``by, frame, width, height``, those with a null frame standing for all frames without one.
    """
    own = sizes.filter("frame is not null").select(*by, "frame", F.col("width").alias("_w"), F.col("height").alias("_h"))
    usual = sizes.filter("frame is null").groupBy(*by).agg(F.max("width").alias("_uw"), F.max("height").alias("_uh"))
    rows = lines.join(own, [*by, "frame"], "left").join(usual, by, "left")
    width, height = F.coalesce("_w", "_uw"), F.coalesce("_h", "_uh")
    ident = F.col("track_id") if "track_id" in lines.columns else F.lit(1).cast("bigint")
    conf = F.col("conf") if "conf" in lines.columns else F.lit(1.0)
    xc, yc, w, h = (F.col(c) for c in ("xc", "yc", "w", "h"))
    return rows.select(
        *by, "frame", ident.alias("id"), ((xc - w / 2) * width).alias("left"), ((yc - h / 2) * height).alias("top"),
        (w * width).alias("w"), (h * height).alias("h"), conf.alias("conf"))


def match_boxes(truth: DataFrame, predictions: DataFrame, by: list[str], iou_min: float = 0.5) -> DataFrame:
    """One row per frame with a true box, a predicted box or both, their overlap, and whether it is a hit."""
    t = truth.select(*by, "frame", *(F.col(c).alias(f"t_{c}") for c in ("left", "top", "w", "h")), F.lit(True).alias("has_t"))
    p = predictions.select(*by, "frame", "pred_id", *(F.col(c).alias(f"p_{c}") for c in ("left", "top", "w", "h")), F.lit(True).alias("has_p"))
    both = t.join(p, [*by, "frame"], "full_outer")
    box = lambda k: tuple(F.col(f"{k}_{c}") for c in ("left", "top", "w", "h"))
    rows = both.withColumns({
        "has_t": F.coalesce("has_t", F.lit(False)), "has_p": F.coalesce("has_p", F.lit(False)), "iou": box_iou(box("t"), box("p"))})
    return rows.withColumn("hit", F.coalesce(F.col("iou") >= iou_min, F.lit(False))).select(
        *by, "frame", "has_t", "has_p", "pred_id", "iou", "hit")


def tracked_sequences(truth: DataFrame, manifest: DataFrame, by: list[str]) -> DataFrame:
    """Truth of the sequences that were tracked, by a manifest of them."""
    return truth.join(manifest.select(*by).distinct(), by, "left_semi")


def tracking_metrics(
    truth: DataFrame, predictions: DataFrame, by: list[str], iou_min: float = 0.5, crowded: bool = True, keep: Keep = as_is
) -> DataFrame:
    """Tracking metrics of every sequence.

    Sequences with one true object and at most one prediction a frame, which is what one animal per cage gives, need no assignment:
    they are joins, windows and sums. Sequences with more go to :func:`crowded_tracking_metrics`, which cuts them in time; those that
    show an id twice in a frame go whole to :func:`_assigned`. The plan itself tells them
    apart. ``crowded=False`` is the caller's word that there are none, and leaves that part of the plan out.

    ``keep(table, name)`` may write a table that several parts of the plan read, and give it as read back: it is then made once, and Spark knows
    how small the list of crowded sequences is before it moves boxes to meet it.
    """
    if not crowded:
        return simple_tracking_metrics(match_boxes(truth, predictions, by, iou_min), by)
    truth = truth if "truth_id" in truth.columns else truth.withColumn("truth_id", F.lit(1).cast("bigint"))
    columns = [*by, "frame", "kind", "id", "left", "top", "w", "h"]
    boxes = truth.withColumns({"kind": F.lit(0), "id": F.col("truth_id")}).select(*columns).unionByName(
        predictions.withColumns({"kind": F.lit(1), "id": F.col("pred_id")}).select(*columns))
    frames = boxes.select(*by, "frame", "kind", "id").repartition(*by, "frame").groupBy(*by, "frame", "kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))
    crowd = frames.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("n_ids")).alias("again")).filter("n > 1")
    crowd = keep(crowd, "crowd")
    apart, unclear = crowd.filter("again = 0").select(*by), crowd.filter("again > 0").select(*by)
    crowd = crowd.select(*by)
    plain = match_boxes(truth.join(crowd, by, "left_anti"), predictions.join(crowd, by, "left_anti"), by, iou_min)
    keys = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in by)
    general = boxes.join(unclear, by, "left_semi").groupBy(*by).applyInPandas(
        lambda key, rows: _assigned(key, rows, by, iou_min), f"{keys}, {GENERAL_SCHEMA}")
    cut = crowded_tracking_metrics(truth.join(apart, by, "left_semi"), predictions.join(apart, by, "left_semi"), by, iou_min, keep)
    return simple_tracking_metrics(plain, by).unionByName(cut).unionByName(general)


def _possible_pairs(truth: DataFrame, predictions: DataFrame, by: list[str], iou_min: float) -> DataFrame:
    """``by, frame, truth_id, pred_id, iou`` of the boxes of a frame that overlap enough to be partners."""
    shape = lambda k: [F.col(c).alias(f"{k}_{c}") for c in ("left", "top", "w", "h")]
    both = truth.select(*by, "frame", "truth_id", *shape("t")).join(predictions.select(*by, "frame", "pred_id", *shape("p")), [*by, "frame"])
    box = lambda k: tuple(F.col(f"{k}_{c}") for c in ("left", "top", "w", "h"))
    return both.withColumn("iou", box_iou(box("t"), box("p"))).filter(F.col("iou") >= iou_min).select(*by, "frame", "truth_id", "pred_id", "iou")


def _parts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by, truth_id, pred_id, together, part``: two ids with the number of frames in which they could be partners, and the part of the sequence in which
    all of these lie. No pair reaches over a part's end, so no partner can be kept from one part into the next."""
    spans = pairs.groupBy(*by, "truth_id", "pred_id").agg(F.min("frame").alias("_first"), F.max("frame").alias("_last"), F.count("*").alias("together"))
    w = Window.partitionBy(*by).orderBy("_first", "_last", "truth_id", "pred_id")
    reached = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("_first") > reached, F.lit(True)).cast("int")
    spans = spans.withColumn("_fresh", fresh).withColumn("part", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.select(*by, "truth_id", "pred_id", "together", "part")


def _with_open(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` with ``_open``: whether an id of their frame could go with two others."""
    whole = Window.partitionBy(*by, "frame")
    distinct = lambda c: F.size(F.collect_set(c).over(whole))
    return pairs.withColumn("_open", F.count("*").over(whole) > F.least(distinct("truth_id"), distinct("pred_id")))


def _clear_and_open(pairs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs of clear frames and those of open ones.

    In a clear frame no id could go with two others, so all its pairs are partners whatever came before. Rows of open frames get ``known_frame``, the object's
    last clear frame before, ``known`` (whether the two were partners in it), and ``part``. A row needs the open frames since then, from the one in which its pair could be partners before (or, where that
    was the clear frame itself, from the object's first open frame); parts are cut wherever no row reaches back over the cut.
    """
    rows = pairs if "_open" in pairs.columns else _with_open(pairs, by)
    own = Window.partitionBy(*by, "truth_id")
    before = own.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    clear = F.when(~F.col("_open"), F.struct("frame", "pred_id"))
    known = rows.withColumns({"_known": F.last(clear, ignorenulls=True).over(before), "_stretch": F.count(clear).over(before)}).withColumns({
        "_again": F.lag("frame").over(Window.partitionBy(*by, "truth_id", "pred_id").orderBy("frame")),
        "_first": F.min(F.when(F.col("_open"), F.col("frame"))).over(Window.partitionBy(*by, "truth_id", "_stretch"))})
    needs = (F.col("_first") < F.col("frame")) & (F.coalesce(F.col("_again") >= F.col("_known.frame"), F.col("_again").isNotNull()))
    found = known.filter("_open").withColumn("_from", F.when(needs, F.greatest("_again", "_first")).otherwise(F.col("frame")))
    # both windows take all rows of a frame together
    found = found.withColumn("_reach", F.min("_from").over(Window.partitionBy(*by).orderBy(F.desc("frame"))))
    found = found.withColumn("part", F.count_if(F.col("_reach") >= F.col("frame")).over(Window.partitionBy(*by).orderBy("frame")))
    columns = [*by, "frame", "truth_id", "pred_id", "iou"]
    return rows.filter("not _open").select(*columns), found.select(
        *columns, F.coalesce(F.col("_known.frame"), F.lit(-(1 << 62))).alias("known_frame"),
        F.coalesce(F.col("_known.pred_id") == F.col("pred_id"), F.lit(False)).alias("known"), "part")


def _partners(key: tuple, rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The partners in each open frame of one part: those before stay together where they still can, the others go at least cost."""
    never = 1e6
    last: dict = {}
    out = []
    rows = rows.sort_values(["frame", "truth_id", "pred_id"])
    frame_of, known_of = rows["frame"].to_numpy(), rows["known_frame"].to_numpy()
    truths, found, overlaps, together = (rows[c].tolist() for c in ("truth_id", "pred_id", "iou", "known"))
    cuts = [0, *(np.flatnonzero(frame_of[1:] != frame_of[:-1]) + 1).tolist(), len(rows)]
    for low, high in zip(cuts, cuts[1:]):
        frame = frame_of[low]
        iou = {(truths[k], found[k]): overlaps[k] for k in range(low, high)}
        for k in range(low, high):
            t = truths[k]
            if t in last and last[t][0] < known_of[k]:
                del last[t]
            if together[k] and t not in last:
                last[t] = known_of[k], found[k]
        names_t = list(dict.fromkeys(truths[low:high]))
        pairs = [(t, last[t][1]) for t in names_t if t in last and (t, last[t][1]) in iou]
        kept_t, kept_p = {t for t, _ in pairs}, {p for _, p in pairs}
        open_t = [t for t in names_t if t not in kept_t]
        open_p = [p for p in sorted(set(found[low:high])) if p not in kept_p]
        if open_t and open_p:
            cost = np.array([[1 - iou[t, p] if (t, p) in iou else never for p in open_p] for t in open_t])
            pairs += [(open_t[i], open_p[j]) for i, j in least_cost_pairs(cost) if cost[i, j] < never]
        for t, p in pairs:
            last[t] = frame, p
            out.append((*key[: len(by)], frame, t, p, iou[t, p]))
    return pd.DataFrame(out, columns=[*by, "frame", "truth_id", "pred_id", "iou"])


def crowded_tracking_metrics(
    truth: DataFrame, predictions: DataFrame, by: list[str], iou_min: float = 0.5, keep: Keep = as_is
) -> DataFrame:
    """Tracking metrics of sequences with several objects or predictions a frame, each id once a frame.

    Boxes of a frame that could be partners are an equi-join. Frames in which each id has one possible partner are settled where they are; only the others
    are solved in order, cut into parts that need nothing from each other (:func:`_clear_and_open`, :func:`_partners`). Switches, fragmentations and covered
    shares are windows over each object's frames; identities over the whole sequence are assigned on the table of common frames, which has a row for two ids,
    not for a frame. Objects and their partners go to the object's task as they are, where frames are put together and looked at in order.
    """
    pairs = keep(_with_open(_possible_pairs(truth, predictions, by, iou_min), by), "pairs")
    clear, unsettled = _clear_and_open(pairs, by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clear.schema)
    solved = unsettled.groupBy(*by, "part").applyInPandas(lambda key, rows: _partners(key, rows, by), kinds)
    partners = clear.unionByName(solved)

    shown = truth.select(*by, "frame", "truth_id").unionByName(partners, allowMissingColumns=True).repartition(*by, "truth_id")
    # an object has one partner a frame at most
    objects = shown.groupBy(*by, "truth_id", "frame").agg(F.max("pred_id").alias("pred_id"), F.max("iou").alias("iou")).withColumn(
        "hit", F.col("pred_id").isNotNull())
    own = Window.partitionBy(*by, "truth_id").orderBy("frame")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    last_hit = F.max(F.when(F.col("hit"), F.col("frame"))).over(Window.partitionBy(*by, "truth_id"))
    objects = objects.withColumns({
        "last_id": F.last("pred_id", ignorenulls=True).over(earlier), "was_hit": F.lag("hit").over(own), "hit_later": F.col("frame") < last_hit})
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    each = objects.groupBy(*by, "truth_id").agg(
        F.count("*").alias("seen"), count(F.col("hit")).alias("hits"), count(F.col("hit") & (F.col("last_id") != F.col("pred_id"))).alias("switches"),
        count(~F.col("hit") & F.col("was_hit") & F.col("hit_later")).alias("fragments"), F.sum(1 - F.col("iou")).alias("distance"))
    share = F.col("hits") / F.col("seen")
    sums = each.groupBy(*by).agg(
        F.sum("seen").alias("num_objects"), F.sum("hits").alias("hits"), F.sum("switches").alias("num_switches"), F.sum("fragments").alias("num_fragmentations"),
        F.sum("distance").alias("distance"), count(share >= 0.8).alias("mostly_tracked"), count((share >= 0.2) & (share < 0.8)).alias("partially_tracked"),
        count(share < 0.2).alias("mostly_lost"))
    frames = truth.select(*by, "frame", F.lit(0).alias("k")).unionByName(predictions.select(*by, "frame", F.lit(1).alias("k"))).groupBy(*by).agg(
        F.count_distinct("frame").alias("num_frames"), F.count_if(F.col("k") == 1).alias("num_predictions"))

    def identities(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names_t, names_p = sorted(set(rows["truth_id"])), sorted(set(rows["pred_id"]))
        at_t, at_p = {t: i for i, t in enumerate(names_t)}, {p: i for i, p in enumerate(names_p)}
        together = np.zeros((len(names_t), len(names_p)))
        together[rows["truth_id"].map(at_t), rows["pred_id"].map(at_p)] = rows["together"]
        return pd.DataFrame([[*key, int(sum(together[i, j] for i, j in least_cost_pairs(-together)))]], columns=[*by, "idtp"])

    by_kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*by).schema)
    idtp = _parts(pairs, by).groupBy(*by).applyInPandas(identities, f"{by_kinds}, idtp bigint")
    rows = frames.join(sums, by, "left").na.fill(0, [
        "num_objects", "hits", "num_switches", "num_fragmentations", "mostly_tracked", "partially_tracked", "mostly_lost"]).join(idtp, by, "left")
    shares = {c: F.col(c) for c in ("mostly_tracked", "partially_tracked", "mostly_lost")}
    return _metrics(rows, by, shares)


def simple_tracking_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("frame")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    matched = F.when(F.col("hit"), F.col("pred_id"))
    rows = rows.withColumns({
        "last_id": F.last(matched, ignorenulls=True).over(earlier),
        # the state of the truth frame before, over truth frames only
        "was_hit": F.last(F.when(F.col("has_t"), F.col("hit")), ignorenulls=True).over(earlier),
        # against the last hit of all: a window over what follows costs the square of the sequence
        "hit_later": F.col("frame") < F.max(F.when(F.col("hit"), F.col("frame"))).over(Window.partitionBy(*by)),
    })
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    sums = rows.groupBy(*by).agg(
        F.countDistinct("frame").alias("num_frames"), count(F.col("has_t")).alias("num_objects"),
        count(F.col("has_p")).alias("num_predictions"), count(F.col("hit")).alias("hits"),
        count(F.col("hit") & (F.col("last_id") != F.col("pred_id"))).alias("num_switches"),
        count(F.col("has_t") & ~F.col("hit") & F.col("was_hit") & F.col("hit_later")).alias("num_fragmentations"),
        F.sum(F.when(F.col("hit"), 1 - F.col("iou"))).alias("distance"))
    best = rows.filter("hit").groupBy(*by, "pred_id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("idtp"))
    return _metrics(sums.join(best, by, "left"), by)


def _metrics(sums: DataFrame, by: list[str], shares: dict[str, Column] | None = None) -> DataFrame:
    hits, objects, predictions = F.col("hits"), F.col("num_objects"), F.col("num_predictions")
    idtp = F.coalesce("idtp", F.lit(0))
    misses, false = objects - hits, predictions - hits
    covered = ratio(hits, objects)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    columns = {
        "num_frames": F.col("num_frames"), "num_objects": objects, "num_predictions": predictions, "num_misses": misses,
        "num_false_positives": false, "num_switches": F.col("num_switches"), "num_fragmentations": F.col("num_fragmentations"),
        "mostly_tracked": flag(covered >= 0.8), "partially_tracked": flag((covered >= 0.2) & (covered < 0.8)),
        "mostly_lost": flag(covered < 0.2), "precision": ratio(hits, hits + false), "recall": covered,
        "mota": 1 - ratio(misses + false + F.col("num_switches"), objects), "motp": ratio(F.col("distance"), hits),
        "idp": ratio(idtp, predictions), "idr": ratio(idtp, objects), "idf1": ratio(2 * idtp, objects + predictions),
    } | (shares or {})
    return sums.select(*by, *(columns[m].alias(m) for m in METRICS))


def least_cost_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of the rows of a matrix to its columns by shortest augmenting paths."""
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, col, low = i, -1, 0.0
        while at >= 0:
            step = low + c[at] - u[at] - v
            better = ~done & (step < reach)
            reach[better], came[better] = step[better], col
            col = int(np.where(done, np.inf, reach).argmin())
            low, done[col], at = reach[col], True, int(row_of[col])
        used = done & (np.arange(m) != col)
        u[i] += low
        u[row_of[used]] += low - reach[used]
        v[used] -= low - reach[used]
        while col >= 0:
            before = int(came[col])
            row_of[col] = row_of[before] if before >= 0 else i
            col = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, r) for r, j in pairs) if flip else sorted(pairs)


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = np.minimum(a[:, None, 0] + a[:, None, 2], b[None, :, 0] + b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 1] + a[:, None, 3], b[None, :, 1] + b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.maximum(wide, 0) * np.maximum(high, 0)
    united = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None, :] - both
    return np.divide(both, united, out=np.zeros_like(both), where=united > 0)


def _assigned(key: tuple, rows: pd.DataFrame, by: list[str], iou_min: float) -> pd.DataFrame:
    """Metrics of one sequence with several objects or predictions a frame: partners of the frame before stay
    together while they overlap enough, the others are assigned at least cost, and identities over the whole
    sequence likewise."""
    never = 1e6
    last: dict = {}
    hit_frames: dict = {}
    seen: dict = {}
    shared: dict = {}
    hits = switches = 0
    distance = 0.0
    rows = rows.sort_values(["frame", "kind", "id"])
    frame_of, ids = rows["frame"].to_numpy(), rows["id"].tolist()
    shapes = rows[["left", "top", "w", "h"]].to_numpy(float)
    cuts = [0, *(np.flatnonzero(np.diff(frame_of)) + 1).tolist(), len(rows)]
    true_before = np.concatenate(([0], np.cumsum(rows["kind"].to_numpy() == 0))).tolist()
    for low, high in zip(cuts, cuts[1:]):
        frame = frame_of[low]
        middle = low + true_before[high] - true_before[low]  # true boxes come before predicted ones
        ti, pi = ids[low:middle], ids[middle:high]
        iou = _overlaps(shapes[low:middle], shapes[middle:high])
        for i in ti:
            seen.setdefault(i, []).append(frame)
        for i, a in enumerate(ti):
            for j, b in enumerate(pi):
                if iou[i, j] >= iou_min:
                    shared[a, b] = shared.get((a, b), 0) + 1
        pairs = [(i, pi.index(last[a])) for i, a in enumerate(ti) if last.get(a) in pi and iou[i, pi.index(last[a])] >= iou_min]
        open_t = [i for i in range(len(ti)) if i not in {x for x, _ in pairs}]
        open_p = [j for j in range(len(pi)) if j not in {y for _, y in pairs}]
        if open_t and open_p:
            cost = 1 - iou[np.ix_(open_t, open_p)]
            cost[cost > 1 - iou_min] = never
            pairs += [(open_t[i], open_p[j]) for i, j in least_cost_pairs(cost) if cost[i, j] < never]
        for i, j in pairs:
            hits += 1
            distance += 1 - iou[i, j]
            switches += ti[i] in last and last[ti[i]] != pi[j]
            last[ti[i]] = pi[j]
            hit_frames.setdefault(ti[i], set()).add(frame)
    objects, predictions = int((rows["kind"] == 0).sum()), int((rows["kind"] == 1).sum())
    fragments, shares = 0, []
    for i, frames in seen.items():
        state = [f in hit_frames.get(i, ()) for f in frames]
        shares.append(sum(state) / len(state))
        if any(state):
            until = len(state) - 1 - state[::-1].index(True)
            fragments += sum(a and not b for a, b in zip(state[:until], state[1 : until + 1]))
    names_t, names_p = sorted(seen), sorted({b for _, b in shared})
    together = np.array([[shared.get((a, b), 0) for b in names_p] for a in names_t], dtype=float).reshape(len(names_t), len(names_p))
    idtp = int(sum(together[i, j] for i, j in least_cost_pairs(-together)))
    part = lambda a, b: a / b if b else None
    misses, false = objects - hits, predictions - hits
    values = [
        rows["frame"].nunique(), objects, predictions, misses, false, switches, fragments,
        sum(s >= 0.8 for s in shares), sum(0.2 <= s < 0.8 for s in shares), sum(s < 0.2 for s in shares),
        part(hits, hits + false), part(hits, objects), None if not objects else 1 - (misses + false + switches) / objects,
        part(distance, hits), part(idtp, predictions), part(idtp, objects), part(2 * idtp, objects + predictions)]
    return pd.DataFrame([[*key, *values]], columns=[*by, *METRICS])


def evaluate_masks(
    pred_objects: DataFrame, pred_runs: DataFrame, true_objects: DataFrame, true_runs: DataFrame, keys: list[str]
) -> DataFrame:
    """Overlap of every predicted mask with the true one of the same key; see :func:`masks_without_truth`."""
    return mask_iou(pred_objects, pred_runs, true_objects, true_runs, keys)


def masks_without_truth(pred_objects: DataFrame, true_objects: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted masks that have no true one: empty when the data are sound."""
    return pred_objects.select(*keys).distinct().join(true_objects.select(*keys).distinct(), keys, "left_anti")


def not_trained_on(videos: DataFrame, trained: DataFrame) -> DataFrame:
    return videos.join(trained, ["camera_id", "video_id"], "left_anti")


def unit_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``bin, n`` over ``[0, 1]`` in equal bins; 1 belongs to the last one. Nulls are left out."""
    slot = F.least(F.lit(bins), F.width_bucket(F.col(value), F.lit(0.0), F.lit(1.0), F.lit(bins))).cast("bigint")
    return df.filter(F.col(value).isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def lowest(df: DataFrame, value: str, n: int, unique: list[str], ties: list[str]) -> DataFrame:
    """The ``n`` rows with the smallest value, of those the first of each key, in order."""
    rows = df.filter(F.col(value).isNotNull()).orderBy(value, *ties).limit(n)
    w = Window.partitionBy(*unique).orderBy(value, *ties)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").orderBy(value, *ties)


def _labels(pairs: DataFrame, true: str, pred: str) -> Column:
    names = pairs.select(F.explode(F.array(true, pred)).alias("l")).agg(F.sort_array(F.collect_set("l")))
    return names.scalar()


def confusion_matrix(pairs: DataFrame, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """``true, pred, n`` for all pairs of labels that occur, zeros included."""
    known = _labels(pairs, true, pred)
    counts = pairs.groupBy(true, pred).agg(F.count("*").alias("n"))
    one = pairs.sparkSession.range(1).select(F.explode(known).alias(true)).select(true, F.explode(known).alias(pred))
    return one.join(counts, [true, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def classification_report(pairs: DataFrame, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """``label, precision, recall, f1, support`` per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    Where a class is never predicted or never true, the ratio is 0.
    """
    tally = pairs.select(F.explode(F.array(
        F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("tp")),
        F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    sums = tally.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = sums.select(
        F.col("label").cast("string").alias("label"), zero(ratio(F.col("tp"), F.col("predicted"))).alias("precision"),
        zero(ratio(F.col("tp"), F.col("support"))).alias("recall"),
        zero(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"), "support", "tp")
    total = F.sum("support")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), total)
    overall = rows.agg(
        ratio(F.sum("tp"), total).alias("acc"), total.alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")),
        *(weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")))
    line = lambda name, *v: F.struct(F.lit(name).alias("label"), *(F.col(c).alias(k) for c, k in zip(v, ("precision", "recall", "f1"))), F.col("n").alias("support"))
    more = overall.select(F.explode(F.array(
        line("accuracy", "acc", "acc", "acc"), line("macro avg", "m_precision", "m_recall", "m_f1"),
        line("weighted avg", "w_precision", "w_recall", "w_f1"))).alias("x")).select("x.*")
    return rows.drop("tp").unionByName(more)


def accuracy(pairs: DataFrame, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    return pairs.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def epoch_loss(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys, "epoch").agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n_batches"))


def best_epochs(log: DataFrame, keys: list[str], loss: str = "mean_loss", score: str = "accuracy") -> DataFrame:
    """The epoch of lowest loss, the first on ties, and the one of highest score, the last on ties."""
    return log.groupBy(*keys).agg(
        F.min_by("epoch", F.struct(loss, "epoch")).alias("best_loss_epoch"),
        F.max_by("epoch", F.struct(score, "epoch")).alias("best_score_epoch"))


def running_best(log: DataFrame, keys: list[str], loss: str = "mean_loss") -> DataFrame:
    """``best_before`` and whether the epoch improves on it; the first epoch does."""
    w = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(loss).over(w)
    return log.withColumn("best_before", before).withColumn(
        "improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def label_histogram(tracks: DataFrame) -> DataFrame:
    """Tracks per label, the most frequent first."""
    return tracks.dropDuplicates(["track_id"]).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
