"""Objects, indexes and slices: counted from 0, checked, and cut to what is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import values
from loomspan.functions.errors import fail
from loomspan.functions.values import once


def spread(*parts: dict[str, Column]) -> Column:
    """A struct of all keys of the parts; later values win, keys keep their first place."""
    merged: dict[str, Column] = {}
    for part in parts:
        merged |= part
    return F.struct(*[x.alias(k) for k, x in merged.items()])


def index(array: Column, i: Column | int) -> Column:
    """Element ``i`` from 0; a negative or too large index is an error."""
    at = (i if isinstance(i, Column) else F.lit(i)).cast("int")
    inside = (at >= 0) & (at < F.size(array))
    return F.when(inside, F.get(array, at)).otherwise(fail("IndexOutOfBounds", "an index is out of bounds"))


def part(array: Column, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """Elements from ``start`` to before ``end``; bounds are cut to the array, negative ones are errors."""

    def bound(x: Column | int | None, default: Column) -> Column:
        if x is None:
            return default
        at = (x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.when(at < 0, fail("NegativeSliceBound", "a slice bound is negative", "int")).otherwise(F.least(at, F.size(array)))

    low, high = bound(start, F.lit(0)), bound(end, F.size(array))
    return F.slice(array, low + 1, F.greatest(high - low, F.lit(0)))


def key(held: Column, name: str) -> Column:
    """The value of a key of a map; a missing key is an error."""
    return F.when(F.map_contains_key(held, name), F.element_at(held, name)).otherwise(fail("MissingObjectKey", f"there is no key {name}"))


def drill(value: Column, *steps: str | int | slice | Column, kind: str = "variant") -> Column:
    """What a value holds below keys, indexes and slices, each checked at its turn.

    A string is a key of an object, an integer an index from 0 of an array, a
    Python slice takes elements (its bounds are cut to the array), and a Column
    is a key or an index as its value turns out. A missing key, an index beyond
    its array, a negative bound and a step into another kind of value are
    errors.
    """
    found = values.as_variant(value)
    for step in steps:
        found = _step(found, step)
    return found if kind == "variant" else F.variant_get(found, "$", kind)


def _step(value: Column, step: str | int | slice | Column) -> Column:
    if isinstance(step, slice):
        if step.step is not None:
            raise ValueError("a slice has no step")
        return _sliced(value, step.start, step.stop)
    if isinstance(step, str):
        return _keyed(value, F.lit(step))
    if not isinstance(step, Column):
        return _indexed(value, F.lit(step).cast("bigint"))

    def dynamic(x: Column) -> Column:
        at, of = x["step"], x["kind"]
        return (
            F.when(of == "int", _indexed(x["value"], F.try_variant_get(at, "$", "bigint")))
            .when(of == "string", _keyed(x["value"], F.try_variant_get(at, "$", "string")))
            .when((of == "float") & (values.kind(x["value"]) == "array"), fail("NonIntegerIndex", "an index is a whole number", "variant"))
            .otherwise(fail("RefShapeMismatch", "a step is a key or an index", "variant"))
        )

    return once(F.struct(value.alias("value"), values.as_variant(step).alias("step"), values.kind(values.as_variant(step)).alias("kind")), dynamic)


def _indexed(value: Column, at: Column) -> Column:
    def use(array: Column) -> Column:
        inside = (at >= 0) & (at < F.size(array))
        return F.when(array.isNull(), fail("RefShapeMismatch", "only an array has indexes", "variant")).when(inside, F.get(array, at.cast("int"))).otherwise(fail("IndexOutOfBounds", "an index is out of bounds", "variant"))

    return once(F.try_variant_get(value, "$", "array<variant>"), use)


def _keyed(value: Column, name: Column) -> Column:
    def use(held: Column) -> Column:
        missing = fail("MissingObjectKey", "an object has no such key", "variant")
        return F.when(held.isNull(), fail("RefShapeMismatch", "only an object has keys", "variant")).when(F.map_contains_key(held, name), F.element_at(held, name)).otherwise(missing)

    return once(F.try_variant_get(value, "$", "map<string,variant>"), use)


def _sliced(value: Column, start: Column | int | None, end: Column | int | None) -> Column:
    def bound(x: Column | int | None, default: Column, size: Column) -> Column:
        if x is None:
            return default
        at = values.as_variant(x)
        whole = F.try_variant_get(at, "$", "bigint")
        checked = F.when(values.kind(at) == "float", fail("NonIntegerSliceBound", "a slice bound is a whole number", "bigint")).when(values.kind(at) != "int", fail("RefShapeMismatch", "a slice bound is a number", "bigint"))
        return checked.when(whole < 0, fail("NegativeSliceBound", "a slice bound is negative", "bigint")).otherwise(F.least(whole, size)).cast("int")

    def use(array: Column) -> Column:
        size = F.size(array)
        low, high = bound(start, F.lit(0), size.cast("bigint")), bound(end, size, size.cast("bigint"))
        taken = values.as_variant(F.slice(array, low + 1, F.greatest(high - low, F.lit(0))))
        return F.when(array.isNull(), fail("RefShapeMismatch", "only an array can be sliced", "variant")).otherwise(taken)

    return once(F.try_variant_get(value, "$", "array<variant>"), use)
