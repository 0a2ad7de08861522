"""Identifiers from addressed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.draws import address, draw

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def uuid(*parts: Column | str | int) -> Column:
    """Version-4 UUID of an address."""
    return uuid_of(F.md5(address(*parts)))


def uuid_of(h: Column) -> Column:
    """Version-4 UUID of a digest of 32 hex digits, which is read several times."""
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hex_digits(n: int, *parts: Column | str | int) -> Column:
    """n lower-case hex digits; none for 0."""
    if n < 0:
        raise ValueError("hex needs n >= 0")
    blocks = [F.md5(address(*parts, i)) for i in range(math.ceil(n / 32))]
    return F.substring(F.concat(*blocks), 1, n) if n else F.lit("")


def alphanumeric(n: int, *parts: Column | str | int) -> Column:
    """n letters and digits; none for 0."""
    if n < 0:
        raise ValueError("alphanum needs n >= 0")
    letters = [F.substring(F.lit(ALPHABET), (F.floor(draw(*parts, i) * len(ALPHABET)) + 1).cast("int"), F.lit(1)) for i in range(n)]
    return F.concat(*letters) if n else F.lit("")
