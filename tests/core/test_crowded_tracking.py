"""Crowded sequences cut in time against the whole-sequence way."""

import math
import random

import pandas as pd
import pytest

from tracklens.operators import evaluation

BOX = "left double, top double, w double, h double"


def sequence(rng, name, frames, animals, noise):
    """Animals that wander, come and go; predicted ids that change now and then."""
    truth, found, ident = [], [], iter(range(100, 10_000))
    place = {a: (rng.uniform(0, 60), rng.uniform(0, 60)) for a in range(animals)}
    shown = {a: next(ident) for a in place}
    for f in range(frames):
        if rng.random() < 0.08:
            continue  # a frame without anything
        for a in place:
            place[a] = tuple(c + rng.uniform(-3, 3) for c in place[a])
            if rng.random() < 0.85:
                truth.append((name, f, a, *place[a], 20.0, 16.0))
            if rng.random() < noise:
                shown[a] = next(ident)
            if rng.random() < 0.8:
                found.append((name, f, shown[a], *(c + rng.uniform(-6, 6) for c in place[a]), 20.0, 16.0))
    return truth, found


@pytest.mark.parametrize("seed,noise", [(1, 0.5), (2, 0.15), (3, 0.02), (4, 0.0)])
def test_parts_give_what_the_whole_gives(spark, seed, noise):
    rng = random.Random(seed)
    truth, found = [], []
    for k in range(6):
        t, p = sequence(rng, f"s{k}", rng.choice([1, 30, 120]), rng.choice([1, 2, 4]), noise)
        truth += t
        found += p
    truth += [("only truth", f, a, 1.0, 1.0, 9.0, 9.0) for f in range(3) for a in (1, 2)]
    found += [("only found", f, a, 1.0, 1.0, 9.0, 9.0) for f in range(3) for a in (1, 2)]
    t = spark.createDataFrame(truth, f"seq string, frame bigint, truth_id bigint, {BOX}")
    p = spark.createDataFrame(found, f"seq string, frame bigint, pred_id bigint, {BOX}")
    got = {r.seq: r.asDict() for r in evaluation.tracking_metrics(t, p, ["seq"]).collect()}
    assert set(got) == {r[0] for r in truth + found}
    columns = ["frame", "id", "left", "top", "w", "h"]
    for name in got:
        rows = pd.concat([pd.DataFrame([r[1:] for r in part if r[0] == name], columns=columns).assign(kind=k) for k, part in ((0, truth), (1, found))])
        whole = evaluation._assigned((name,), rows, ["seq"], 0.5).iloc[0]
        for m in evaluation.METRICS:
            a, b = got[name][m], whole[m]
            assert (a is None and (b is None or math.isnan(b))) or a == pytest.approx(b, abs=1e-9), (name, m)
    if noise >= 0.5:
        pairs = evaluation._possible_pairs(t, p, ["seq"], 0.5)
        most = evaluation._parts(pairs, ["seq"]).groupBy("seq").agg({"part": "max"}).agg({"max(part)": "max"}).first()[0]
        assert most > 10


def test_an_id_twice_in_a_frame_goes_whole(spark):
    t = spark.createDataFrame([("s", f, 0.0, 0.0, 10.0, 10.0) for f in range(4)] + [("s", 2, 50.0, 0.0, 10.0, 10.0)], f"seq string, frame bigint, {BOX}")
    p = spark.createDataFrame([("s", f, 7, 0.0, 0.0, 10.0, 10.0) for f in range(4)], f"seq string, frame bigint, pred_id bigint, {BOX}")
    row = evaluation.tracking_metrics(t, p, ["seq"]).first()
    assert (row.num_objects, row.num_misses, row.num_false_positives) == (5, 1, 0)
