"""One JSON array file cut anywhere, against the json module."""

import json
import random

import pyarrow as pa
import pytest

from tracklens.sources import array_stream
from tracklens.sources.array_stream import array_items, items_of, moves_of, stream_annotations

AWKWARD = [
    {"a": "brackets ] } [ { , in a \"string\""}, {"b": "back\\slash \\\" and \\\\"}, {"c": ["é漢😀", " ", "\t\\"]}, [], {}, [[1, [2, "]"]]],
    "plain, text", "\\", "\\\\\"", 12.5, None, True, {"d": {"e": {"f": "}" * 50}}}, "x" * 5000, {"k,": ","}]


@pytest.mark.parametrize("text", [json.dumps(AWKWARD), json.dumps(AWKWARD, ensure_ascii=False, indent=2), " \n[ ]\n", "[]", "[ 1 ]", json.dumps([{}])])
def test_every_cut(text):
    """All cuts into ranges of one length, moves put together by hand."""
    data = text.encode()
    f = pa.BufferReader(data)
    expected = json.loads(text)
    for step in [1, 2, 3, 5, 7, 11, 64, 1000, len(data)]:
        place, depth, found = 0, 0, []
        for begin in range(0, len(data), step):
            end = min(len(data), begin + step)
            found += items_of(f, begin, end, place, depth)
            place, deeper = moves_of(f, begin, end)[place]
            depth += deeper
        assert (place, depth) == (0, 0)
        assert [json.loads(t) for _, t in found if t.strip()] == expected


def test_blocks_inside_ranges(monkeypatch):
    monkeypatch.setattr(array_stream, "BLOCK_BYTES", 13)
    test_every_cut(json.dumps(AWKWARD, indent=1))


def test_files_of_arrays(spark, tmp_path):
    rng = random.Random(4)
    files = {"one.json": [{"n": k, "s": rng.choice(["", "a]", "\\\"", "é" * 40])} for k in range(500)], "none.json": [], "few.json": ["é,", {"z": [1]}]}
    for name, items in files.items():
        (tmp_path / name).write_text(json.dumps(items, ensure_ascii=False))
    rows = array_items(spark, str(tmp_path), range_bytes=301, tasks=9).collect()
    for name, items in files.items():
        own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r["at"])
        assert [json.loads(r.value) for r in own] == items
    assert array_items(spark, str(tmp_path), range_bytes=301, tasks=9).rdd.getNumPartitions() == 9


def test_no_array_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1, 2]}')
    with pytest.raises(Exception, match="not a JSON array"):
        array_items(spark, str(tmp_path), range_bytes=4).collect()


def test_tasks_as_the_whole_file_reader_gives_them(spark, tmp_path):
    from tracklens.sources.readers import read_annotations

    tasks = [{"inner_id": k, "total_annotations": k % 2, "data": {"video": f"/v/H{k}%2CI1/{k}.mp4", "framesCount": 9, "duration": 1.5},
              "annotations": [{"id": k, "result": [{"id": "r]", "value": {"labels": ["a,b"], "sequence": [{"frame": 1, "x": 1, "y": 2, "width": 3, "height": 4}]}}]}]}
             for k in range(60)]
    (tmp_path / "export.json").write_text(json.dumps(tasks))
    got, expected = stream_annotations(spark, str(tmp_path), 256), read_annotations(spark, str(tmp_path))
    assert sorted(got.drop("labeler").collect()) == sorted(expected.drop("labeler").collect())
    assert got.schema["annotations"].dataType == expected.schema["annotations"].dataType


def test_array_files_of_partitions(spark, tmp_path):
    values = spark.range(0, 50, 1, 3).filter("id < 30 or id = 49").selectExpr("""concat('{"n":', id, '}') as value""").repartition(7, "value")
    array_stream.write_arrays(values, str(tmp_path / "out"))
    files = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted(t["n"] for f in files for t in f) == [*range(30), 49] and sum(map(bool, files)) > 1
    array_stream.write_arrays(values.filter("false").coalesce(1), str(tmp_path / "none"))
    assert array_items(spark, str(tmp_path / "none")).collect() == []


def test_array_stream_writes_files_in_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    from tracklens.plans import adapters, scale_queries

    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100, raising=False)
    monkeypatch.setattr(scale_queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    rows = scale_queries.array_stream(spark, sf_dir)
    files = [len(json.loads(f.read_text())) for f in (tmp_path / "array").glob("part-*")]
    n = adapters.table(spark, sf_dir, "orders").count()
    assert sum(files) == n and max(files) < n // 4
    assert rows.select("video_idx").distinct().count() == n - n // 10
