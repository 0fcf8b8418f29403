"""Tracking metrics of long sequences: no step may cost the square of a sequence, or hold it whole in one group."""

import random

import pandas as pd
import pytest

from tracklens.operators import evaluation
from tracklens.sources import sinks

BOX = "left double, top double, w double, h double"


def boxes(spark, rows, ident):
    return spark.createDataFrame(rows, f"seq string, frame bigint, {ident} bigint, {BOX}")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_simple_sequences_look_at_no_rows_that_follow(spark):
    hits = [0, 1, 1, 0, 0, 1, 0, 1, 0]
    truth = boxes(spark, [("s", f, 1, 0.0, 0.0, 10.0, 10.0) for f in range(len(hits))], "truth_id").drop("truth_id")
    found = boxes(spark, [("s", f, 7, 0.0 if hit else 50.0, 0.0, 10.0, 10.0) for f, hit in enumerate(hits)], "pred_id")
    out = evaluation.tracking_metrics(truth, found, ["seq"], crowded=False)
    # misses between two hits, counted where they begin; the last miss has no hit behind it
    assert out.first().num_fragmentations == 2
    assert ", 1, unboundedfollowing" not in plan_of(out)


def test_only_frames_with_a_choice_go_to_groups(spark):
    # two objects apart; now and then the second prediction comes near the first object too
    truth, found = [], []
    for f in range(300):
        near = f % 50 == 49
        truth += [("s", f, 1, 0.0, 0.0, 10.0, 10.0), ("s", f, 2, 4.0 if near else 40.0, 0.0, 10.0, 10.0)]
        found += [("s", f, 11, 1.0, 0.0, 10.0, 10.0), ("s", f, 12, 3.0 if near else 40.0, 0.0, 10.0, 10.0)]
    truth, found = boxes(spark, truth, "truth_id"), boxes(spark, found, "pred_id")
    clear, unsettled = evaluation._clear_and_open(evaluation._possible_pairs(truth, found, ["seq"], 0.3), ["seq"])
    assert clear.count() == 2 * 294
    rows = unsettled.collect()
    assert {r.frame for r in rows} == set(range(49, 300, 50)) and len({r.part for r in rows}) == 6
    out = evaluation.tracking_metrics(truth, found, ["seq"], 0.3)
    assert ", 1, unboundedfollowing" not in plan_of(out)
    assert (out.first().num_misses, out.first().num_switches, out.first().idf1) == (0, 0, 1.0)


def test_state_of_open_frames_reaches_over_clear_ones(spark):
    rng = random.Random(5)
    truth, found = [], []
    for k in range(40):
        many, dense = rng.choice([2, 3, 4]), rng.uniform(8, 40)
        for f in range(40):
            for a in range(many):
                if rng.random() < 0.7:
                    truth.append((f"s{k}", f, a, rng.uniform(0, dense), 0.0, 20.0, 16.0))
                if rng.random() < 0.7:
                    found.append((f"s{k}", f, 10 + a, rng.uniform(0, dense), 0.0, 20.0, 16.0))
    got = {r.seq: r.asDict() for r in evaluation.tracking_metrics(boxes(spark, truth, "truth_id"), boxes(spark, found, "pred_id"), ["seq"]).collect()}
    columns = ["frame", "id", "left", "top", "w", "h"]
    for name in got:
        parts = [pd.DataFrame([r[1:] for r in part if r[0] == name], columns=columns).assign(kind=k) for k, part in ((0, truth), (1, found))]
        whole = evaluation._assigned((name,), pd.concat(parts), ["seq"], 0.5).iloc[0]
        for m in evaluation.METRICS:
            assert got[name][m] == pytest.approx(whole[m], abs=1e-9), (name, m)


def test_tables_that_are_read_again_are_made_once(spark, sf_dir, tmp_path):
    from tracklens.plans import export_queries

    plan = export_queries.crowded_tracking(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # neither boxes nor the list of crowded sequences are made anew by each part, and that list is too small for its sequences' boxes to be moved to it
    assert "l_orderkey" not in plan
    rng = random.Random(11)
    box = "left double, top double, w double, h double"
    place = lambda: (rng.uniform(0, 12), rng.uniform(0, 12), 20.0, 16.0)
    truth = [(f"s{k}", f, a, *place()) for k in range(8) for f in range(30) for a in range(1 + k % 3) if rng.random() < 0.9]
    found = [(f"s{k}", f, rng.randrange(3) * 4 + a, *place()) for k in range(8) for f in range(30) for a in range(1 + k % 3) if rng.random() < 0.9]
    truth += [("twice", f, 0, *place()) for f in range(9) for _ in range(2)]
    t = spark.createDataFrame(truth, f"seq string, frame bigint, truth_id bigint, {box}")
    p = spark.createDataFrame(found, f"seq string, frame bigint, pred_id bigint, {box}")
    names = []

    def keep(table, name):
        names.append(name)
        return sinks.kept(table, str(tmp_path / name))

    kept, plain = (evaluation.tracking_metrics(t, p, ["seq"], 0.3, keep=k) for k in (keep, evaluation.as_is))
    rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rounded(kept) == rounded(plain) and sorted(names) == ["crowd", "pairs"]
