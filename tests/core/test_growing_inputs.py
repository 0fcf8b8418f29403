"""What one task holds does not grow with the tables."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from tracklens.operators import masks, quadtree
from tracklens.plans import adapters, export_queries, interval_queries, scale_queries
from tracklens.streaming.ingest import annotation_stream, ingest_annotations, ingested_lines


def test_array_files_grow_in_number(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(export_queries, "TASKS_A_FILE", 100)
    monkeypatch.setattr(export_queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    rows = export_queries.annotation_files(spark, sf_dir)
    n = export_queries.table(spark, sf_dir, "orders").count()
    files = [json.load(open(f)) for f in glob.glob(f"{tmp_path}/exports/*/*.txt")]
    assert sum(map(len, files)) == n and len(files) >= n // 100 and max(map(len, files)) <= 100
    assert rows.select("video_idx").distinct().count() == n - n // 10


@pytest.mark.parametrize("assign", [masks.assign_cages, quadtree.assign_cages_by_quadtree])
def test_points_of_one_place_are_dealt(spark, assign):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        index = spark.range(400).select(
            F.col("id").cast("string").alias("track_id"), F.lit(1).cast("bigint").alias("video_id"), F.lit(1).cast("bigint").alias("frame_begin"),
            F.lit(0.3).alias("mean_x"), F.lit(0.3).alias("mean_y"))
        segments = spark.createDataFrame([(1, 0, 0, 9)], "video_id bigint, segment_idx bigint, start bigint, end bigint")
        runs = spark.createDataFrame([(1, 0, "c0", 0, y, 0, 7) for y in range(8)], "video_id bigint, segment_idx bigint, cage_id string, cage_ord int, y int, x0 int, x1 int")
        out = assign(index, segments, runs, 8, 8, ["video_id"]).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(out) == 400 and {r.cage_id for r in out} == {"c0"} and len({r.at for r in out}) > 1


@pytest.mark.parametrize("nested", [interval_queries.nested_tasks, export_queries._tasks])
def test_nested_tasks_go_to_more_tasks(spark, sf_dir, monkeypatch, nested):
    lines = adapters.table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100, raising=False)
    assert nested(spark, sf_dir).rdd.getNumPartitions() >= lines // 100


def test_frames_do_not_make_mask_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(scale_queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    rows = scale_queries.nested_masks(spark, sf_dir)
    assert rows.count() == adapters.adapter(spark, sf_dir, "a4").count()
    assert 0 < len(glob.glob(f"{tmp_path}/nested/**/part-*", recursive=True)) <= 4


def test_a_stream_opens_as_many_stores_as_it_is_told(spark, tmp_path):
    box = lambda f: {"frame": f, "x": 20, "y": 10, "width": 40, "height": 60}
    tasks = [{"inner_id": i, "total_annotations": 1, "data": {"video": f"/d/c{i % 2}/v{i}.mp4", "framesCount": 9, "duration": 1.0}, "annotations": [
        {"id": 1, "result": [{"id": f"r{i}", "value": {"labels": ["b"], "sequence": [box(f) for f in range(1, 9)]}}]}]} for i in range(20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(t) for t in tasks) + "\n")
    targets = spark.createDataFrame([(f"c{i % 2}", f"v{i}", f, 10.0, 10.0) for i in range(20) for f in range(1, 9)],
                                    "camera_id string, video_id string, frame bigint, ls_fps double, fps double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream = annotation_stream(spark, str(tmp_path / "in"))
    ingest_annotations(stream, targets, str(tmp_path / "out"), str(tmp_path / "state"), partitions=2).awaitTermination(120)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    stores = {p.name for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()}
    files = list((tmp_path / "out").glob("run=*/batch=*/camera_id=*/*.parquet"))
    assert stores == {"0", "1"} and len(files) == 4  # a file for each store and camera
    assert ingested_lines(spark, str(tmp_path / "out"), targets).filter("track_id is not null").count() == 160


@pytest.mark.parametrize("rows_a_task", [100, 250_000])
def test_more_stream_files_make_no_more_batches(spark, sf_dir, tmp_path, monkeypatch, rows_a_task):
    monkeypatch.setattr(adapters, "ROWS_A_TASK", rows_a_task)
    monkeypatch.setattr(export_queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    export_queries.stream_ingest(spark, sf_dir)
    files, batches = list((tmp_path / "ingest" / "in").glob("part-*")), list((tmp_path / "ingest" / "out").glob("run=*/batch=*"))
    assert len(batches) == 2 and len(files) >= (4 if rows_a_task > 100 else 50)
    assert all(f.name.endswith(".json.gz") for f in files)
    written = [f.name for f in (tmp_path / "ingest" / "out").glob("run=*/batch=*/camera_id=*/*.parquet")]
    assert written and all(name.endswith(".zstd.parquet") for name in written)
