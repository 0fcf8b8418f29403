"""Numbers and ranges with the rules that the pipeline relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames_between(first: Column, last: Column) -> Column:
    """The frames from ``first`` to ``last``; empty, not descending, when ``last`` lies before."""
    return F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))


def truncated(x: Column) -> Column:
    """Toward zero."""
    return x.cast("bigint")


def clipped(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seeded_order(seed: int, *parts: Column) -> Column:
    """A pseudo-random sort key that a SQL engine with md5 can repeat."""
    text = [F.lit(str(seed))]
    for p in parts:
        text += [F.lit("|"), p.cast("string")]
    return F.md5(F.concat(*text))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")
