"""Number functions: integers stay integers, rounding goes away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.errors import fail


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(low > high, fail("ClampBoundsOutOfOrder", "clamp needs low <= high", "double")).otherwise(F.greatest(low, F.least(high, x)))


def clamp_int(x: Column, low: int, high: int) -> Column:
    if low > high:
        raise ValueError("clamp needs low <= high")
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), x))


def round_half_away(x: Column) -> Column:
    """To an integer, halves away from zero; beyond 64 bits an error."""
    return F.round(x).cast("bigint")


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


absolute, least, most = F.abs, F.least, F.greatest


def divide(a: Column, b: Column) -> Column:
    """Integer quotient towards zero; a zero divisor is an error."""
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend; a zero divisor is an error."""
    return a % b
