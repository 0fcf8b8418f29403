"""Draws without replacement by a keyed permutation: the work is in proportion to what is drawn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Bits of each round's value, from the first seven digits of an md5.
_DIGITS = 7
#: An image beyond the range is permuted again; each time at least half are inside.
WALK = 128


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


def _permuted_once(x: Column, key: Column, bits: Column) -> Column:
    """A Feistel permutation of ``0 .. 2**bits - 1``: in every round the upper part changes by a value of the lower one and the two change
    places; parts of odd widths take turns."""
    low = F.floor(bits / 2).cast("bigint")
    begin = F.struct(
        F.floor(x / _power(low)).cast("bigint").alias("upper"), F.pmod(x, _power(low)).alias("lower"), (bits - low).alias("high"), low.alias("low"))

    def one_round(s: Column, number: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("|"), number.cast("string"), F.lit("|"), s["lower"].cast("string"))), 1, _DIGITS)
        mixed = F.pmod(s["upper"] + F.conv(digits, 16, 10).cast("bigint"), _power(s["high"]))
        return F.struct(s["lower"].alias("upper"), mixed.alias("lower"), s["low"].alias("high"), s["high"].alias("low"))

    return F.aggregate(
        F.array(*(F.lit(k) for k in range(ROUNDS))), begin, one_round, lambda s: s["upper"] * _power(s["low"]) + s["lower"])


def bits_of(n: Column) -> Column:
    """The least number of bits, 2 at least, with ``2**bits >= n``."""
    return F.greatest(F.lit(2).cast("bigint"), F.length(F.bin(F.greatest(n - 1, F.lit(0).cast("bigint")))).cast("bigint"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where the keyed permutation of ``0 .. n - 1`` puts ``x``; the draw of ``k`` is where it puts ``0 .. k - 1``.

    Images beyond ``n`` are permuted again until they lie inside (cycle walking), which keeps it a permutation.
    """
    bits = bits_of(n)
    start = _permuted_once(x, key, bits)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda y, _: F.when(y < n, y).otherwise(_permuted_once(y, key, bits)))
    return F.when(start < n, start).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation did not end")).cast("bigint")))
