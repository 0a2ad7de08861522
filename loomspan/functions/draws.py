"""Draws that depend on their address only, never on evaluation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pieces:
    """Text in pieces, of which some are known when the expression is built."""

    def __init__(self, pieces: list[Column | str]):
        self.pieces = pieces


def address(*parts: Column | Pieces | str | int) -> Column:
    """Text of an address such as (seed, trace, path, slot, call); parts that are known already are one literal."""
    pieces: list[Column | str] = []
    for i, part in enumerate(parts):
        for piece in (["|"] if i else []) + ([part] if isinstance(part, Column) else list(part.pieces) if isinstance(part, Pieces) else [str(part)]):
            if isinstance(piece, str) and pieces and isinstance(pieces[-1], str):
                pieces[-1] += piece
            else:
                pieces.append(piece)
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces]
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def draw(*parts: Column | Pieces | str | int) -> Column:
    """Uniform in [0, 1) with 52 bits, the same wherever and whenever it is evaluated."""
    return F.conv(F.substring(F.md5(address(*parts)), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)
