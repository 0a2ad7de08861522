"""Operators over values whose kind is known only when they are there.

A value read by reference, or one of several alternatives, is a VARIANT. These
operators look at its kind and then do what typed columns would: integers stay
integers, an integer and a float meet as floats, equality tolerates null, and
kinds that don't go together are an error, not false. Typed columns, Python
scalars and None are taken as values too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.errors import fail
from loomspan.functions.strings import float_text

_LEAST = -(1 << 63)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain_null(x) -> bool:
    """Whether this is a null written as such, which has no type."""
    return x is None or (isinstance(x, Column) and str(x) == "Column<'NULL'>")


def as_variant(x) -> Column:
    """Any value as VARIANT of its own kind; NULL, None and a plain null as VARIANT null."""
    if plain_null(x):
        return F.parse_json(F.lit("null"))
    if not isinstance(x, Column):
        x = F.lit(x)
    return F.variant_get(F.to_variant_object(F.struct(x.alias("v"))), "$.v", "variant")


def kind(value: Column) -> Column:
    """null, boolean, string, int, float, array or object; another type by its name."""
    return once(F.schema_of_variant(value), _kind)


def _kind(found: Column) -> Column:
    return (
        F.when(found.isNull() | (found == "VOID"), "null")
        .when(found == "BIGINT", "int")
        .when(found.isin("DOUBLE", "FLOAT") | found.startswith("DECIMAL"), "float")
        .when(found.isin("STRING", "BOOLEAN"), F.lower(found))
        .when(found.startswith("ARRAY"), "array")
        .when(found.startswith("OBJECT"), "object")
        .otherwise(F.lower(found))
    )


def whole(x: Column | int, kind_if_real: str) -> Column:
    """A typed or referenced integer as bigint; a float is an error of the kind given, anything else a mismatch.

    What the type of a typed column decides, the optimizer decides.
    """
    if not isinstance(x, Column):
        return F.lit(x).cast("bigint")
    of, value = F.typeof(x), as_variant(x)
    real = of.isin("double", "float") | of.startswith("decimal") | ((of == "variant") & (kind(value) == "float"))
    typed = F.when(of.isin("bigint", "int", "smallint", "tinyint"), x.cast("bigint")).when((of == "variant") & (kind(value) == "int"), F.try_variant_get(value, "$", "bigint"))
    return typed.when(real, fail(kind_if_real, "a whole number is asked for", "bigint")).otherwise(fail("RefShapeMismatch", "a number is asked for", "bigint"))


class _Seen:
    """A value with its kind, inside an expression that evaluates both once."""

    def __init__(self, held: Column):
        self.value, self.kind = held["value"], held["kind"]

    def is_(self, *kinds: str) -> Column:
        return self.kind.isin(*kinds) if len(kinds) > 1 else self.kind == kinds[0]

    @property
    def number(self) -> Column:
        return self.is_("int", "float")

    def to(self, type_: str) -> Column:
        return F.try_variant_get(self.value, "$", type_)


def _seen(use: Callable[..., Column], *values) -> Column:
    """``use`` of values and kinds."""
    held = F.transform(F.array(*map(as_variant, values)), lambda v: F.struct(v.alias("value"), kind(v).alias("kind")))
    return once(held, lambda x: use(*[_Seen(F.get(x, F.lit(i))) for i in range(len(values))]))


def _mismatch(what: str, of: str | None = None) -> Column:
    return fail("RefShapeMismatch", what, of)


def equal(a, b) -> Column:
    """Whether two scalars are the same; null equals null only, other kinds that differ are an error."""

    def use(x: _Seen, y: _Seen) -> Column:
        return (
            F.when(~x.is_("null", "string", "boolean", "int", "float") | ~y.is_("null", "string", "boolean", "int", "float"), _mismatch("only scalars can be equal"))
            .when(x.is_("null") | y.is_("null"), x.kind == y.kind)
            .when(x.is_("string") & y.is_("string"), x.to("string") == y.to("string"))
            .when(x.is_("boolean") & y.is_("boolean"), x.to("boolean") == y.to("boolean"))
            .when(x.is_("int") & y.is_("int"), x.to("bigint") == y.to("bigint"))
            .when(x.number & y.number, x.to("double") == y.to("double"))
            .otherwise(_mismatch("values of different kinds can't be equal"))
        )

    return _seen(use, a, b)


def differ(a, b) -> Column:
    return ~equal(a, b)


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def use(x: _Seen, y: _Seen) -> Column:
        whole = F.when(x.is_("int") & y.is_("int"), compare(x.to("bigint"), y.to("bigint")))
        return whole.when(x.number & y.number, compare(x.to("double"), y.to("double"))).otherwise(_mismatch("only numbers have an order"))

    return lambda a, b: _seen(use, a, b)


less, at_most = _ordered(lambda x, y: x < y), _ordered(lambda x, y: x <= y)
greater, at_least = _ordered(lambda x, y: x > y), _ordered(lambda x, y: x >= y)


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), fail("NonFiniteResult", "a result is not finite", "double")).otherwise(x)


def _whole(x: Column) -> Column:
    """The result of a checked operation on integers, null where it overflowed."""
    return F.coalesce(x, fail("NonFiniteResult", "a result is beyond 64 bits", "bigint"))


def _arithmetic(whole: Callable[[Column, Column], Column], real: Callable[[Column, Column], Column], divides: bool = False) -> Callable[..., Column]:
    def use(x: _Seen, y: _Seen) -> Column:
        i, j, a, b = x.to("bigint"), y.to("bigint"), x.to("double"), y.to("double")
        ints, floats = _whole(whole(i, j)), _finite(real(a, b))
        if divides:
            zero = fail("DivisionByZero", "a divisor is zero")
            over = (i == _LEAST) & (j == -1)
            ints = F.when(j == 0, zero.cast("bigint")).when(over, _whole(F.lit(None).cast("bigint"))).otherwise(ints)
            floats = F.when(b == 0, zero.cast("double")).otherwise(floats)
        both = F.when(x.is_("int") & y.is_("int"), ints.cast("variant"))
        return both.when(x.number & y.number, floats.cast("variant")).otherwise(_mismatch("arithmetic takes numbers", "variant"))

    return lambda a, b: _seen(use, a, b)


add = _arithmetic(F.try_add, lambda a, b: a + b)
subtract = _arithmetic(F.try_subtract, lambda a, b: a - b)
multiply = _arithmetic(F.try_multiply, lambda a, b: a * b)
#: Integers divide towards zero, and a remainder has the sign of the dividend.
divide = _arithmetic(lambda i, j: F.call_function("div", i, j), lambda a, b: a / b, divides=True)
remainder = _arithmetic(lambda i, j: i % j, lambda a, b: a % b, divides=True)


def negate(a) -> Column:
    def use(x: _Seen) -> Column:
        whole = F.when(x.is_("int"), _whole(F.try_subtract(F.lit(0).cast("bigint"), x.to("bigint"))).cast("variant"))
        return whole.when(x.is_("float"), (-x.to("double")).cast("variant")).otherwise(_mismatch("only numbers can be negated", "variant"))

    return _seen(use, a)


def _cast(type_: str, *kinds: str) -> Callable[..., Column]:
    return lambda a: _seen(lambda x: F.when(x.is_(*kinds), x.to(type_)).otherwise(_mismatch(f"{kinds[0]} is asked for", type_)), a)


#: A value as a typed column; another kind is an error. Integers are floats too.
as_boolean, as_text, as_int, as_float = _cast("boolean", "boolean"), _cast("string", "string"), _cast("bigint", "int"), _cast("double", "float", "int")
as_array = _cast("array<variant>", "array")


def both(a, b) -> Column:
    """Whether both hold; ``b`` isn't looked at where ``a`` doesn't."""
    return F.when(as_boolean(a), as_boolean(b)).otherwise(False)


def either(a, b) -> Column:
    """Whether one holds; ``b`` isn't looked at where ``a`` does."""
    return F.when(as_boolean(a), True).otherwise(as_boolean(b))


def opposite(a) -> Column:
    return ~as_boolean(a)


def pick(condition, then, otherwise) -> Column:
    """One of two values of any kinds; the other isn't evaluated."""
    return F.when(as_boolean(condition), as_variant(then)).otherwise(as_variant(otherwise))


def text(a) -> Column:
    """A scalar as templates write it; floats keep their point."""

    def use(x: _Seen) -> Column:
        written = F.when(x.is_("string"), x.to("string")).when(x.is_("boolean"), x.to("boolean").cast("string"))
        return written.when(x.is_("int"), x.to("bigint").cast("string")).when(x.is_("float"), float_text(x.to("double"))).otherwise(_mismatch("only scalars can be written", "string"))

    return _seen(use, a)


def length(a) -> Column:
    """Code points of a string, elements of an array."""

    def use(x: _Seen) -> Column:
        counted = F.when(x.is_("string"), F.char_length(x.to("string"))).when(x.is_("array"), F.size(x.to("array<variant>")))
        return counted.otherwise(_mismatch("only strings and arrays have a length", "int")).cast("bigint")

    return _seen(use, a)


def holds(array, needle) -> Column:
    """Whether an array has a scalar; elements of other kinds are passed over."""

    def same(x: _Seen, y: _Seen) -> Column:
        whole = F.when(x.is_("int") & y.is_("int"), x.to("bigint") == y.to("bigint")).when(x.number & y.number, x.to("double") == y.to("double"))
        return whole.when(x.is_("string") & y.is_("string"), x.to("string") == y.to("string")).when(x.is_("boolean") & y.is_("boolean"), x.to("boolean") == y.to("boolean")).otherwise(False)

    scalar = _seen(lambda x: F.when(x.is_("string", "boolean", "int", "float"), x.value).otherwise(_mismatch("a scalar is looked for", "variant")), needle)
    return F.exists(as_array(array), lambda v: _seen(same, v, scalar))
