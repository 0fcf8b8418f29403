"""Single rows: the first match or an error, and a seeded pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.numbers import seeded_order


def lookup_one(df: DataFrame, column: str, value, order: list[str] | None = None) -> DataFrame:
    """The first row whose ``column`` has the value; an error when there is none."""
    rows = df.filter(F.col(column) == value).orderBy(*(order or [column])).limit(1)
    message = F.raise_error(F.lit(f"no row with {column} = {value}"))
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    found = one.join(rows.withColumn("_hit", F.lit(1)), F.col("_one") == F.col("_hit"), "left")
    return found.withColumn("_hit", F.when(F.col("_hit").isNull(), message.cast("int")).otherwise(F.col("_hit"))).filter(
        "_hit = 1").select(*df.columns)


def pick_one(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """One row by the md5 order of seed and keys."""
    return df.orderBy(seeded_order(seed, *(F.col(k) for k in keys)), *keys).limit(1)
