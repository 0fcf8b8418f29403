"""Row filters on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_filled(*columns: str) -> Column:
    """Whether one of the columns is neither null nor empty."""
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in columns]
    out = filled[0]
    for c in filled[1:]:
        out = out | c
    return out


def contacts(df: DataFrame, columns: list[str], mentions: tuple[str, str] | None = None, among: tuple[str, list] | None = None) -> DataFrame:
    """Rows where one of ``columns`` is filled, a column contains a text, and a column is in a list."""
    rows = df.filter(any_filled(*columns))
    if mentions:
        rows = rows.filter(F.col(mentions[0]).contains(mentions[1]))
    return rows.filter(F.col(among[0]).isin(among[1])) if among else rows


def in_splits(df: DataFrame, splits: DataFrame, wanted: str, key: str = "camera_id") -> DataFrame:
    """Rows whose key belongs to a split."""
    return df.join(splits.filter(F.col("split") == wanted).select(key), key, "left_semi")
