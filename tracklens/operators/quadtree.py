"""Point location by a quadtree: masks as square cells in Morton order, points as Morton codes.

A cell of side ``2**l`` is a stretch of ``4**l`` codes. Cells are no larger than a chunk (side ``2**chunk_level``), so a point lies in one
chunk and meets the cells of that chunk alone, by an equi-join whose keys are as many as the masks have chunks, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.operators.masks import copied, dealt, point_cell

CHUNK_LEVEL = 5
#: The masks that spread the 16 bits of a coordinate over every other bit.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(x: Column) -> Column:
    out = x.cast("bigint")
    for shift, keep in SPREAD:
        out = out.bitwiseOR(F.call_function("shiftleft", out, F.lit(shift))).bitwiseAND(F.lit(keep).cast("bigint"))
    return out


def morton(x: Column, y: Column) -> Column:
    """The bits of two coordinates below 65,536 in turn, those of ``y`` above."""
    return _spread(x).bitwiseOR(F.call_function("shiftleft", _spread(y), F.lit(1)))


def _morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.int64), y.astype(np.int64)
    for shift, keep in SPREAD:
        x, y = (x | x << shift) & keep, (y | y << shift) & keep
    return x | y << 1


def cells_of(mask: np.ndarray, chunk_level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first and last codes of the greatest full cells of a mask, size by size."""
    side = 1 << chunk_level
    full = np.pad(mask, [(0, -n % side) for n in mask.shape])
    for level in range(chunk_level + 1):
        above = full.reshape(full.shape[0] // 2, 2, full.shape[1] // 2, 2).all(axis=(1, 3)) if level < chunk_level else None
        own = full if above is None else full & ~above.repeat(2, 0).repeat(2, 1)
        y, x = np.nonzero(own)
        low = _morton(x, y) << (2 * level)
        yield low, low + (1 << (2 * level)) - 1
        full = above


def quadtree(runs: DataFrame, keys: list[str], chunk_level: int = CHUNK_LEVEL) -> DataFrame:
    """``keys, chunk, cells`` of the masks of ``runs`` (``keys, cage_id, cage_ord, y, x0, x1``): a row for each chunk that any mask
    reaches, its cells by mask order. A mask is cut into cells in one task; chunks hold ``4**chunk_level`` cells a mask at most."""
    masks = runs.groupBy(*keys, "cage_id", "cage_ord").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in masks.select(*keys, "cage_id", "cage_ord").schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                mask = np.zeros((max(r["y"] for r in found) + 1, max(r["x1"] for r in found) + 1), bool)
                for r in found:
                    mask[r["y"], r["x0"] : r["x1"] + 1] = True
                low, high = (np.concatenate(part) for part in zip(*cells_of(mask, chunk_level)))
                own = [c.slice(k, 1).take(pa.array(np.zeros(len(low), np.int64))) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(low), pa.array(high)], names=[*batch.schema.names[:-1], "low", "high"])

    cells = masks.mapInArrow(cut, f"{kinds}, low bigint, high bigint")
    chunk = F.call_function("shiftright", F.col("low"), F.lit(2 * chunk_level)).alias("chunk")
    return cells.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct("cage_ord", "low", "high", "cage_id"))).alias("cells"))


def cages_by_quadtree(points: DataFrame, tree: DataFrame, keys: list[str], height: int, width: int, chunk_level: int = CHUNK_LEVEL) -> DataFrame:
    """Adds ``cage_id``, as :func:`tracklens.operators.masks.cages_of_points` does: of the masks that hold a point the first in mask order, null
    without one."""
    cx, cy = point_cell(F.col("mean_x"), F.col("mean_y"), height, width)
    rows = points.withColumn("_code", morton(cx, cy))
    rows = rows.withColumn("chunk", F.call_function("shiftright", F.col("_code"), F.lit(2 * chunk_level)))
    hit = F.get(F.filter("cells", lambda c: (c["low"] <= F.col("_code")) & (F.col("_code") <= c["high"])), F.lit(0))
    met = dealt(rows, points.columns).join(copied(tree), [*keys, "chunk", "_deal"], "left")
    return met.withColumn("cage_id", hit["cage_id"]).drop("_code", "chunk", "cells", "_deal")


def assign_cages_by_quadtree(
    index: DataFrame, segments: DataFrame, runs: DataFrame, height: int, width: int, by: list[str], chunk_level: int = CHUNK_LEVEL
) -> DataFrame:
    """:func:`tracklens.operators.masks.assign_cages` by a quadtree."""
    from tracklens.operators.masks import segment_lookup

    first = index.groupBy(*by).agg(F.min("frame_begin").alias("frame"))
    at = segment_lookup(first, segments, by).drop("frame")
    keys = [*by, "segment_idx"]
    # the cells of the one segment that a video needs: tracks meet them at once by video and chunk and are not gathered by video alone
    tree = quadtree(runs.join(at, keys, "left_semi"), by, chunk_level)
    return cages_by_quadtree(index, tree, by, height, width, chunk_level).filter("cage_id is not null")
