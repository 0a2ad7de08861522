"""String functions with literal separators and Unicode white space."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.errors import fail

upper, lower = F.upper, F.lower


def trim(s: Column) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def replace(s: Column, search: str, by: str) -> Column:
    """All occurrences; an empty search changes nothing."""
    return F.replace(s, F.lit(search), F.lit(by)) if search else s


def split(s: Column, separator: str | Column) -> Column:
    """Parts between literal separators, empty parts included; an empty separator is an error."""
    if isinstance(separator, Column):
        quoted = F.concat(F.lit("\\Q"), F.replace(separator, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return F.split(s, F.when(separator == "", fail("EmptySplitSeparator", "split needs a separator", "string")).otherwise(quoted), -1)
    if not separator:
        raise ValueError("split needs a separator")
    return F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def join(parts: Column, separator: str) -> Column:
    """Elements with the separator between; a null element is an error."""
    checked = F.transform(parts, lambda x: F.when(x.isNull(), fail("JoinElementNotScalar", "join has a null element", "string")).otherwise(x.cast("string")))
    return F.array_join(checked, separator)


def contains(target: Column, needle: Column) -> Column:
    return F.contains(target, needle)


def contains_element(array: Column, needle: Column) -> Column:
    return F.array_contains(array, needle)


starts_with, ends_with = F.startswith, F.endswith


def length(s: Column) -> Column:
    """Code points."""
    return F.char_length(s).cast("bigint")


def size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def float_text(x: Column) -> Column:
    """Text of a double with all its digits; whole numbers keep ``.0``."""
    plain = F.format_string("%.1f", x)
    return F.when((F.abs(x) < 1e15) & (x == F.floor(x)), plain).otherwise(x.cast("string"))


def template(*parts: Column | str) -> Column:
    """Text with holes filled."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def format(pattern: str, *values: Column) -> Column:  # noqa: A001
    """Pattern with one ``{}`` a value."""
    pieces = pattern.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError("format needs one {} for each value")
    return template(pieces[0], *[x for pair in zip(values, pieces[1:]) for x in pair])


def tokens(s: Column, vocabulary: str, pattern: str) -> Column:
    """Byte-pair tokens of a text, or of a container's JSON text, under the ranks in ``vocabulary``; null for null.

    The file holds base64 tokens and ranks, one a line; a missing file is an
    error. Runs on Arrow batches; a worker reads the file once.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoding(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([None if x is None else len(own.encode_ordinary(x)) for x in texts], dtype="Int64")

    return count(s)


def container_tokens(x: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of an array, struct, map or VARIANT as its JSON text."""
    return tokens(F.to_json(x), vocabulary, pattern)


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
