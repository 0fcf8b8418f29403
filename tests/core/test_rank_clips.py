"""Clips by rank blocks against plain Python, and the keyed stream of several starts."""

import json
import random
import shutil

import pytest

from tracklens.operators import clips
from tracklens.streaming.ingest import annotation_stream, ingest_annotations, ingested_lines

INDEX = "track_id string, camera_id string, video_id string, cage_id string, label string, frame_begin bigint, frame_end bigint, split string"


def brute(rows, frames, size, stride):
    out = []
    for track, camera, video, cage, label, begin, end, split in rows:
        own = sorted({f for c, v, g, f in frames if (c, v, g) == (camera, video, cage) and begin <= f <= end})
        for k, at in enumerate(range(0, len(own) - size + 1, stride)):
            out += [(split, label.lower().replace(" ", "_"), track, cage, k, p, own[at + p]) for p in range(size)]
    return sorted(out)


@pytest.mark.parametrize("seed,span", [(1, 1), (2, 7), (3, 64), (4, 4096)])
def test_clips_of_any_block_size(spark, seed, span):
    rng = random.Random(seed)
    frames = [("c", f"v{v}", g, f) for v in range(3) for g in "ab" for f in range(-20, 200) if rng.random() < 0.6]
    rows = [(f"t{k}", "c", f"v{rng.randrange(4)}", rng.choice("ab"), "Some Label", b := rng.randrange(-30, 210), b + rng.randrange(-3, 90), "train") for k in range(60)]
    rows += rows[:3]  # repeated rows make their clips again
    got = clips.behavior_clips(spark.createDataFrame(rows, INDEX), spark.createDataFrame(frames + frames[:50], "camera_id string, video_id string, cage_id string, frame bigint"),
                               num_frames=5, stride=3, span=span)
    assert sorted(map(tuple, got.collect())) == brute(rows, frames, 5, 3)


def test_short_tracks_and_strict(spark):
    frames = spark.createDataFrame([("c", "v", "a", f) for f in range(100)], "camera_id string, video_id string, cage_id string, frame bigint")
    row = lambda t, b, e: (t, "c", "v", "a", "x", b, e, "train")
    index = spark.createDataFrame([row("long", 10, 60), row("short", 95, 200), row("none", 200, 300), row("back", 9, 3), row("cut", 6, 9)], INDEX)
    for span in (4, 8, 1000):
        assert sorted((r.track_id, r.n) for r in clips.short_tracks(index, frames, 16, span).collect()) == [("cut", 4), ("short", 5)]
    with pytest.raises(Exception, match="fewer frames than a clip has"):
        clips.behavior_clips(index, frames, strict=True).collect()
    assert clips.behavior_clips(index.filter("track_id = 'long'"), frames, strict=True).count() == 5 * 16
    assert clips.behavior_clips(index.limit(0), frames).collect() == []


def test_tracks_are_not_expanded_before_the_join(spark):
    """What is shuffled of a long track is a row a block."""
    frames = spark.range(50_000).selectExpr("'c' camera_id", "'v' video_id", "id frame")
    index = spark.range(20).selectExpr("string(id) track_id", "'c' camera_id", "'v' video_id", "'x' label", "id frame_begin", "49999 frame_end", "'train' split")
    held = clips._held_frames(index, frames, ["camera_id", "video_id"], 256)
    assert held.count() == 20 * 196
    assert held.selectExpr("sum(size(held))").first()[0] == sum(50_000 - k for k in range(20))


def test_replayed_and_late_tasks_over_five_starts(spark, tmp_path):
    sequence = lambda *frames: {"labels": ["b"], "sequence": [{"frame": f, "x": 10 * f, "y": 0, "width": 20, "height": 20} for f in frames]}
    task = lambda video, **tracks: json.dumps({"inner_id": 1, "total_annotations": 1, "data": {"video": f"/d/c{video % 2}/v{video}.mp4", "framesCount": 9, "duration": 1.0},
                                               "annotations": [{"id": 1, "result": [{"id": t, "value": sequence(*f)} for t, f in tracks.items()]}]})
    batches = [[task(1, r=(1, 2)), task(2, r=(3,))], [task(1, r=(1, 2))], [task(1, late=(1,)), task(3, r=(9,))], [task(2, r=(3, 4))],
               [task(1, r=(1, 2)), task(1, late=(1,)), task(2, r=(3, 4)), task(3, r=(9,))]]
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    targets = spark.createDataFrame([(f"c{v % 2}", f"v{v}", f, 9.0, 9.0) for v in (1, 2, 3) for f in range(1, 9)], "camera_id string, video_id string, frame bigint, ls_fps double, fps double")
    totals = []
    for k, lines in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(lines))
        query = ingest_annotations(annotation_stream(spark, str(source)), targets, str(sink), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None
        totals.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        if k == 1:  # a batch that was written is no longer needed to know what has come
            run = next(sink.glob("run=*"))
            shutil.move(run / "batch=0", tmp_path / "kept")
    assert totals == [3, 3, 4, 5, 5]
    shutil.move(tmp_path / "kept", run / "batch=0")
    got = [(r.video_id, r.frame, r.track_id) for r in ingested_lines(spark, str(sink), targets).collect() if r.track_id]
    assert sorted(got) == [("v1", 1, "late"), ("v1", 1, "r"), ("v1", 2, "r"), ("v2", 3, "r"), ("v2", 4, "r")]
    # a batch that is run again finds its own folder: the last commit is lost
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    ingest_annotations(annotation_stream(spark, str(source)), targets, str(sink), str(tmp_path / "state")).awaitTermination(120)
    again = [(r.video_id, r.frame, r.track_id) for r in ingested_lines(spark, str(sink), targets).collect() if r.track_id]
    assert sorted(again) == sorted(got)
