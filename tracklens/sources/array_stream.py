"""One huge JSON array file read by many tasks.

Where a byte lies (inside a string, behind a backslash, how deep) depends on all bytes before it. So each byte range first works out where
it would end from each of the three places a range can begin in (depths add up); these moves are put together along the file, and
then each range, which now knows where it begins, gives the items whose separator lies in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.sources import schemas

RANGE_BYTES = 32 << 20
#: Bytes looked at together.
BLOCK_BYTES = 1 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2


def _open(path: str) -> pa.NativeFile:
    """A file of any store that ``pyarrow.fs`` knows."""
    if re.match("file:/+|/", path):
        return pafs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _plain_of(block: np.ndarray, place: int) -> tuple[np.ndarray, int]:
    """Which bytes of a block are outside strings (quotes count as inside), and where the block ends."""
    slash = block == 0x5C
    at = np.arange(len(block), dtype=np.int32)
    # how many backslashes stand right before each byte, one more where the block begins behind one
    other = np.maximum.accumulate(np.where(slash, np.int32(-1), at))
    before = np.concatenate([[np.int32(-1)], other[:-1]])
    run = at - 1 - before + ((before < 0) & (place == ESCAPED))
    quote = (block == 0x22) & (run % 2 == 0)
    seen = np.cumsum(quote, dtype=np.int32) + (place != OUTSIDE)
    inside = seen % 2 == 1
    end = INSIDE if inside[-1] else OUTSIDE
    if end == INSIDE and slash[-1]:
        run_with = run[-1] + 1
        end = ESCAPED if run_with % 2 else INSIDE
    return ~inside & ~quote, end


def _steps(block: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """What each byte adds to the depth."""
    up, down = (block == 0x5B) | (block == 0x7B), (block == 0x5D) | (block == 0x7D)
    return ((up & plain).astype(np.int8) - (down & plain).astype(np.int8)).astype(np.int32)


def _blocks(f: pa.NativeFile, begin: int, end: int) -> Iterator[np.ndarray]:
    for at in range(begin, end, BLOCK_BYTES):
        data = f.read_at(min(BLOCK_BYTES, end - at), at)
        if data:
            yield np.frombuffer(data, np.uint8)


def moves_of(f: pa.NativeFile, begin: int, end: int) -> list[tuple[int, int]]:
    """Where a range ends and how much deeper, from each place in which it may begin."""
    now = [(OUTSIDE, 0), (INSIDE, 0), (ESCAPED, 0)]
    for block in _blocks(f, begin, end):
        after = {}
        for place in {p for p, _ in now}:
            plain, last = _plain_of(block, place)
            after[place] = last, int(_steps(block, plain).sum())
        now = [(after[p][0], depth + after[p][1]) for p, depth in now]
    return now


def items_of(f: pa.NativeFile, begin: int, end: int, place: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """The items behind the separators of a range (the bracket that opens the array, commas between items), with their place in the file;
    the last one is read on beyond the range."""
    size, at, item_at, parts = f.size(), begin, None, []
    while at < size and (at < end or item_at is not None):
        # a block never reaches over the range's end, so separators beyond it only end an item
        length = min(BLOCK_BYTES, (end if at < end else size) - at)
        data = f.read_at(length, at)
        block = np.frombuffer(data, np.uint8)
        plain, place = _plain_of(block, place)
        steps = _steps(block, plain)
        depths = depth + np.cumsum(steps)
        opens = (steps == 1) & (depths == 1) & (block == 0x5B)
        closes = (steps == -1) & (depths == 0) & (block == 0x5D)
        commas = plain & (block == 0x2C) & (depths == 1)
        if depth == 0 and begin == 0 and at == 0:
            first = data.lstrip()[:1]
            if first not in (b"[", b""):
                raise ValueError("not a JSON array")
        low = 0
        for k in np.flatnonzero(opens | closes | commas).tolist():
            if item_at is not None:
                parts.append(data[low:k])
                yield item_at, b"".join(parts)
                parts, item_at = [], None
            if at < end and not closes[k]:
                item_at, low = at + k + 1, k + 1
            elif at >= end:
                return
        if item_at is not None:
            parts.append(data[low:])
        depth = int(depths[-1])
        at += length


def byte_ranges(spark: SparkSession, path, range_bytes: int) -> DataFrame:
    """``path, begin, end`` of stretches of every file; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").filter("length > 0")
    begins = F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)"))
    return files.select("path", "length", begins.alias("begin")).select(
        "path", "begin", F.least(F.col("begin") + range_bytes, F.col("length")).alias("end"))


def array_items(spark: SparkSession, path, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """``path, at, value`` of every item of the JSON array files below ``path``: the item's text and its byte in the file.

    Both passes deal ranges of ``range_bytes`` over ``tasks`` tasks, whatever files they are from. Between them one row a range, with three
    moves, is put together file by file. Items of any kind and length are given whole, by the task of the separator before them.
    An empty array has no items; a file that holds no array is an error.
    """
    n = tasks or 4 * spark.sparkContext.defaultParallelism
    ranges = byte_ranges(spark, path, range_bytes).repartition(n, "path", "begin")

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    found.append(moves_of(f, row["begin"], row["end"]))
            flat = [pa.array([m[k][j] for m in found], pa.int64()) for k in range(3) for j in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flat], names=["path", "begin", "end", "p0", "d0", "p1", "d1", "p2", "d2"])

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("begin")
        place, depth, out = OUTSIDE, 0, []
        for r in rows.itertuples():
            out.append((r.path, r.begin, r.end, place, depth))
            place, deeper = ((r.p0, r.d0), (r.p1, r.d1), (r.p2, r.d2))[place]
            depth += deeper
        return pd.DataFrame(out, columns=["path", "begin", "end", "place", "depth"])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    held, n_held = [], 0
                    for at, text in items_of(f, row["begin"], row["end"], row["place"], row["depth"]):
                        if text.strip():
                            held.append((at, text))
                            n_held += len(text)
                        if n_held > BLOCK_BYTES:
                            yield item_batch(row["path"], held)
                            held, n_held = [], 0
                    yield item_batch(row["path"], held)

    def item_batch(name: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(held), pa.string()), pa.array([a for a, _ in held], pa.int64()),
             pa.array([t.strip() for _, t in held], pa.binary()).cast(pa.string())], names=["path", "at", "value"])

    ranged = "path string, begin bigint, end bigint"
    moved = ranges.mapInArrow(moves, f"{ranged}, p0 bigint, d0 bigint, p1 bigint, d1 bigint, p2 bigint, d2 bigint")
    known = moved.groupBy("path").applyInPandas(put_together, f"{ranged}, place bigint, depth bigint")
    return known.repartition(n, "path", "begin").mapInArrow(items, "path string, at bigint, value string")


def write_arrays(values: DataFrame, path: str) -> None:
    """Writes texts of JSON values, one column, as an array file for each partition, in the partition's order. Nothing is gathered."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows:
                before = pa.array(["," if begun or k else "[" for k in range(batch.num_rows)])
                begun = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(before, batch.column(0), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    values.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def stream_annotations(spark: SparkSession, path, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """The tasks of large array exports, as :func:`tracklens.sources.readers.read_annotations` gives them, by many tasks a file."""
    rows = array_items(spark, path, range_bytes, tasks)
    return rows.select(F.from_json("value", schemas.TASKS).alias("t"), F.col("path").alias("labeler")).select("t.*", "labeler")
