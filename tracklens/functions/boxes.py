"""Box geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklens.functions.numbers import ratio, truncated


def percent_corner_to_center(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Percent corner box to normalised centre box."""
    return {"xc": (x + w / 2) / 100, "yc": (y + h / 2) / 100, "wn": w / 100, "hn": h / 100}


def center_to_pixels(xc: Column, yc: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Normalised centre box to pixel left, top, width and height."""
    width, height = F.lit(width), F.lit(height)
    return {"left": (xc - w / 2) * width, "top": (yc - h / 2) * height, "w_px": w * width, "h_px": h * height}


def center_to_corners(xc: Column, yc: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    width, height = F.lit(width), F.lit(height)
    return {
        "x0": xc * width - 0.5 * w * width, "y0": yc * height - 0.5 * h * height,
        "x1": xc * width + 0.5 * w * width, "y1": yc * height + 0.5 * h * height,
    }


def pixel_corners(xc: Column, yc: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Integer corners; the first is only held from below, the second only from above."""
    width, height = F.lit(width), F.lit(height)
    return {
        "px1": F.greatest(F.lit(0), truncated((xc - w / 2) * width)),
        "py1": F.greatest(F.lit(0), truncated((yc - h / 2) * height)),
        "px2": F.least((width - 1).cast("bigint"), truncated((xc + w / 2) * width)),
        "py2": F.least((height - 1).cast("bigint"), truncated((yc + h / 2) * height)),
    }


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two left, top, width, height boxes; null when either is missing or both are empty."""
    (al, at, aw, ah), (bl, bt, bw, bh) = a, b
    wide = F.greatest(F.lit(0.0), F.least(al + aw, bl + bw) - F.greatest(al, bl))
    high = F.greatest(F.lit(0.0), F.least(at + ah, bt + bh) - F.greatest(at, bt))
    both = wide * high
    # greatest and least skip nulls, so a missing box has to be asked for
    return F.when(al.isNotNull() & bl.isNotNull(), ratio(both, aw * ah + bw * bh - both))


def label_line(class_id: Column, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, xc, yc, w, h)


def parse_line(line: Column, fields: int) -> Column:
    """The numbers of a text line with at least ``fields`` of them, else null."""
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) >= fields, F.transform(parts, lambda p: p.try_cast("double")))


def relative_to_crop(
    xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column,
    x_min: Column, y_min: Column, x_max: Column, y_max: Column,
) -> dict[str, Column]:
    """A box in a crop's own normalised coordinates; the crop's size is ``max - min`` by rule."""
    cw, ch = x_max - x_min, y_max - y_min
    return {
        "cxc": ratio(xc * width - x_min, cw), "cyc": ratio(yc * height - y_min, ch),
        "cw": ratio(w * width, cw), "ch": ratio(h * height, ch),
    }


def square_crop(cx: Column, cy: Column, width, height, size: int) -> dict[str, Column]:
    """A square of ``size`` pixels around a centre, and how far it reaches over each edge."""
    half, width, height = size // 2, F.lit(width).cast("bigint"), F.lit(height).cast("bigint")
    px, py = truncated(cx * width), truncated(cy * height)
    zero = F.lit(0).cast("bigint")
    return {
        "sx1": F.greatest(zero, px - half), "sy1": F.greatest(zero, py - half),
        "sx2": F.least(width, px + half), "sy2": F.least(height, py + half),
        "pad_left": F.greatest(zero, half - px), "pad_top": F.greatest(zero, half - py),
        "pad_right": F.greatest(zero, px + half - width), "pad_bottom": F.greatest(zero, py + half - height),
    }
