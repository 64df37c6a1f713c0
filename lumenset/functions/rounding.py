"""Rounding of doubles as SQL engines do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` times a power of ten, to the nearest whole number (halves away from zero), and divided again, all in doubles.

    Spark's ``round`` goes by the decimal digits that a double prints instead, so values that lie about halfway differ in the last
    digit, and orders by them in their places.
    """
    power = 10.0**digits
    y = x.cast("double") * power
    size = F.abs(y)
    whole = F.floor(size)
    near = F.signum(y) * (whole + F.when(size - whole >= 0.5, 1).otherwise(0))
    return F.when(size < 2.0**52, near).otherwise(y) / power  # larger ones have no fraction; null stays


def steady_avg(x: Column) -> Column:
    """The mean of a double column, the same in whatever order rows come and tasks add them up.

    Values go in two parts: multiples of 2**-20, whose sum is exact below 2**33, and the small rests.
    """
    small = F.abs(x) < 2.0**32
    part = F.when(small, F.rint(x * 2.0**20) / 2.0**20).otherwise(x)
    return (F.sum(part) + F.sum(F.when(small, x - part).otherwise(F.when(x.isNotNull(), 0.0)))) / F.count(x)
