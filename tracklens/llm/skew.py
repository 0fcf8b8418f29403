"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the left rows; so there are at most ``1 / HOT_SHARE`` of them, which bounds the broadcast.
HOT_SHARE = 0.001
#: Below this many rows no task is too large, so no key is hot.
SMALL_ROWS = 20_000


def hot_keys(left: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame | None:
    """The keys with ``share`` or more of the rows as a small local table; None without any. Costs a pass over the key columns."""
    spark = left.sparkSession
    total = left.count()
    if total < SMALL_ROWS:
        return None
    keys = left.select(*on).dropna()
    found = keys.groupBy(*on).count().filter(F.col("count") >= max(2, int(share * total))).select(*on)
    rows = found.collect()  # at most 1 / share
    return spark.createDataFrame(rows, keys.schema) if rows else None


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key (small rows), whatever share of ``left`` one key holds.

    The rows of hot keys stay where they are and meet the few right rows of these keys by broadcast; the others are shuffled.
    ``left`` is read three times, so it should be a written table. ``how`` is ``inner`` or ``left``; null keys meet nothing.
    """
    hot = hot_keys(left, on)
    if hot is None:
        return left.join(right, on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    return left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how).unionByName(
        left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))


def join_dealt(left: DataFrame, right: DataFrame, on: str, by: str | None, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has few rows per key (of any width), whatever share of ``left`` one key holds.

    The rows of a hot key are dealt over tasks by the hash of column ``by`` (None: by their number, for a ``left`` that is
    read straight from files, where a task that runs again gives the same), a task for each ``HOT_SHARE`` of all rows, and its right rows are copied for each of these tasks: ``2 / HOT_SHARE`` copies at most for all hot keys together. ``left`` is
    read once; shares are counted in ``keys``, a written table with the same rows (``left`` itself by default). ``how`` is
    ``inner`` or ``left``; null keys meet nothing.
    """
    rows = (left if keys is None else keys).select(on)
    total = rows.count()
    if total < SMALL_ROWS:
        return left.join(right, on, how)
    least = max(2, int(HOT_SHARE * total))
    found = rows.dropna().groupBy(on).count().filter(F.col("count") >= least).select(
        on, F.ceil(F.col("count") / least).cast("int").alias("_deals")).collect()  # at most 1 / HOT_SHARE rows
    if not found:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, rows.select(on, F.lit(0).alias("_deals")).schema))
    deals = F.coalesce("_deals", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_deal", F.pmod(F.xxhash64(by) if by else F.monotonically_increasing_id(), deals).cast("int")).drop("_deals")
    copies = right.join(hot, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return dealt.join(copies, [on, "_deal"], how).drop("_deal")
