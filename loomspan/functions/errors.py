"""Errors of evaluation, each with a kind that callers can tell apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of errors that evaluating a shape can end in.
KINDS = [
    "DivisionByZero", "NonFiniteResult", "IndexOutOfBounds", "NonIntegerIndex", "MissingObjectKey", "NonIntegerSliceBound", "NegativeSliceBound", "NegativeRepeatCount",
    "NonIntegerRepeatCount", "ChanceOutOfRange", "ClampBoundsOutOfOrder", "EmptySplitSeparator", "JoinElementNotScalar", "CircularReference", "AbsentRefField", "RefShapeMismatch",
]


def fail(kind: str, message: str, of: str | None = None) -> Column:
    """An expression that ends the job with an error of ``kind``; ``of`` is the type it stands in for."""
    if kind not in KINDS:
        raise ValueError(f"no kind of error {kind}")
    raised = F.raise_error(F.lit(f"{kind}: {message}"))
    return raised.cast(of) if of else raised
