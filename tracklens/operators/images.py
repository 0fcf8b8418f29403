"""Pixel crops over rows of Spark's image schema."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)


def _image(origin: str, pixels: np.ndarray, mode: int) -> tuple:
    return (origin, pixels.shape[0], pixels.shape[1], pixels.shape[2], mode, np.ascontiguousarray(pixels).tobytes())


def _masked(pixels: np.ndarray, runs, box: tuple[slice, slice]) -> np.ndarray:
    """The box of an image, black outside ``runs`` (all of it stays without any)."""
    if runs is None:
        return pixels[box]
    inside = np.zeros(pixels.shape[:2], dtype=bool)
    for r in runs:
        inside[r["y"], r["x0"] : r["x1"] + 1] = True
    return np.where(inside[box][:, :, None], pixels[box], 0).astype(np.uint8)


def cut_images(images: DataFrame, crops: DataFrame, keys: list[str], black_out: bool = True) -> DataFrame:
    """All crops of every image, as :func:`crop_images_mask` makes them, with each image moved once.

    ``images`` holds ``keys`` and the image columns; ``crops`` ``keys, cage_id``, the box and ``runs``. The two are cogrouped by ``keys``, so an
    image meets all its crops in one task and is never copied for one. ``origin`` becomes ``{image}_cage_{cage}``. Images without crops and
    crops without an image give nothing.
    """

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out, wanted = [], right.to_pylist()
        for row in left.to_pylist() if wanted else []:
            pixels = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
            for c in wanted:
                box = slice(c["y_min"], c["y_max"] + 1), slice(c["x_min"], c["x_max"] + 1)
                name = f"{row['origin']}_cage_{c['cage_id']}"
                out.append(_image(name, _masked(pixels, c["runs"] if black_out else None, box), row["mode"]))
        kinds = [("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())]
        columns = zip(*out) if out else [()] * len(kinds)
        return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, columns)})

    wanted = crops.select(*keys, "cage_id", "x_min", "y_min", "x_max", "y_max", *(["runs"] if black_out else []))
    shots = images.select(*keys, "origin", "height", "width", "nChannels", "mode", "data")
    return shots.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(cut, IMAGE)


def crop_images_mask(images: DataFrame, black_out: bool = True) -> DataFrame:
    """Crops each image to ``x_min, y_min, x_max, y_max`` (inclusive) and blackens what ``runs`` do not cover.

    ``images`` holds the image columns, the box and ``runs array<struct<y, x0, x1>>``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                box = slice(row.y_min, row.y_max + 1), slice(row.x_min, row.x_max + 1)
                out.append(_image(row.origin, _masked(_pixels(row), row.runs if black_out else None, box), row.mode))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    names = ["origin", "height", "width", "nChannels", "mode", "data", "x_min", "y_min", "x_max", "y_max"]
    return images.select(*names, *(["runs"] if black_out else [])).mapInPandas(run, IMAGE)


def crop_images_square(images: DataFrame) -> DataFrame:
    """Cuts ``sx1, sy1, sx2, sy2`` out of each image and pads it with black by ``pad_*``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                cut = _pixels(row)[row.sy1 : row.sy2, row.sx1 : row.sx2]
                padded = np.pad(cut, ((row.pad_top, row.pad_bottom), (row.pad_left, row.pad_right), (0, 0)))
                out.append(_image(row.origin, padded, row.mode))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    names = ["sx1", "sy1", "sx2", "sy2", "pad_left", "pad_top", "pad_right", "pad_bottom"]
    return images.select("origin", "height", "width", "nChannels", "mode", "data", *names).mapInPandas(run, IMAGE)
