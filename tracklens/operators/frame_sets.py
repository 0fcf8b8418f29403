"""Sets of frames as bitmaps, a row for every :data:`BUCKET` frame numbers: no row holds a video's frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.operators.intervals import KEY, _island_rows

#: Frames of one bitmap, as in Spark's bitmap functions; frame ``f`` is bit ``f % BUCKET`` of bucket ``f div BUCKET``, from 0.
BUCKET = 32_768
BYTES = BUCKET // 8


def range_bitmap(low: Column, high: Column) -> Column:
    """The bitmap with the bits from ``low`` to ``high`` (of one bucket) set; the lowest bit of a byte comes first."""
    first, last = F.floor(low / 8).cast("int"), F.floor(high / 8).cast("int")
    head = F.call_function("shiftleft", F.lit(255), F.pmod(low, F.lit(8)).cast("int")).bitwiseAND(255)
    tail = F.call_function("shiftright", F.lit(255), (7 - F.pmod(high, F.lit(8))).cast("int"))
    shown = lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")
    edges = F.when(first == last, shown(head.bitwiseAND(tail))).otherwise(F.concat(shown(head), F.repeat(F.lit("FF"), last - first - 1), shown(tail)))
    return F.unhex(F.concat(F.repeat(F.lit("00"), first), edges, F.repeat(F.lit("00"), BYTES - 1 - last)))


def covered_bitmaps(tracks: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``keys, bucket, bits`` of the frames that any track covers: a bitmap a covered stretch and bucket, or-ed by Spark in each task first.

    Frames below 0 do not exist and are left out; the last bucket of a stretch is as long as it is.
    """
    rows = _island_rows(tracks, keys).filter("last >= 0").withColumn("first", F.greatest(F.col("first"), F.lit(0).cast("bigint")))
    rows = rows.select(*keys, "first", "last", F.explode(F.expr(f"sequence(first div {BUCKET}, last div {BUCKET})")).alias("bucket"))
    low = F.greatest(F.col("first") - F.col("bucket") * BUCKET, F.lit(0).cast("bigint"))
    high = F.least(F.col("last") - F.col("bucket") * BUCKET, F.lit(BUCKET - 1).cast("bigint"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_or_agg(range_bitmap(low, high)).alias("bits"))


def frame_bitmaps(frames: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``keys, bucket, bits`` of the frames of a table ``keys, frame``, which may repeat."""
    at = F.col("frame") + 1  # Spark counts positions from 1
    rows = frames.filter("frame >= 0").select(*keys, (F.bitmap_bucket_number(at) - 1).alias("bucket"), F.bitmap_bit_position(at).alias("_bit"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def union(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return a.select(*keys, "bucket", "bits").unionByName(b.select(*keys, "bucket", "bits")).groupBy(*keys, "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))


def difference(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The frames of ``a`` that ``b`` does not hold, bucket by bucket; empty buckets go."""

    @F.pandas_udf("binary")
    def without(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right)
        return pd.Series([bytes(x) if y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in pairs], dtype=object)

    both = a.join(b.select(*keys, "bucket", F.col("bits").alias("_other")), [*keys, "bucket"], "left")
    return both.select(*keys, "bucket", without("bits", "_other").alias("bits")).filter(F.bitmap_count("bits") > 0)


def counts(sets: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``keys, n``: how many frames each set holds."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def frames_of(sets: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``keys, frame`` of every frame of the sets."""

    @F.pandas_udf("array<int>")
    def places(bits: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")).astype(np.int32) for b in bits], dtype=object)

    rows = sets.select(*keys, "bucket", F.explode(places("bits")).alias("_at"))
    return rows.select(*keys, (F.col("bucket") * BUCKET + F.col("_at")).alias("frame"))
