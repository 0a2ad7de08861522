"""Operators over values of unknown kind, paths into values, wide draws: against Python, and their errors."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.functions import draws, errors, objects, samplers, values

#: One value of each kind, and pairs of a kind.
SOME = [None, True, False, "", "a", "1", 0, 1, 2, -7, 1.0, 2.5, -7.5, 9_007_199_254_740_993, -(1 << 63), [], [1, "a"], {}, {"k": 1}]


def made_value(x):
    if isinstance(x, float):
        return values.as_variant(F.lit(x))
    return F.parse_json(F.lit(json.dumps(x)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def failing(spark, column):
    with pytest.raises(Exception) as e:
        one(spark, column)
    return next((k for k in errors.KINDS if f"{k}:" in str(e.value)), str(e.value))


def kind_of(x):
    return {type(None): "null", bool: "boolean", str: "string", int: "int", float: "float", list: "array", dict: "object"}[type(x)]


def test_kinds(spark):
    got = spark.range(1).select(*[values.kind(values.as_variant(made_value(x))).alias(f"k{i}") for i, x in enumerate(SOME)]).first()
    assert list(got) == [kind_of(x) for x in SOME]
    assert one(spark, values.kind(values.as_variant(F.lit(None)))) == "null" and one(spark, values.kind(values.as_variant(F.lit(None).cast("bigint")))) == "null"
    assert one(spark, values.kind(F.parse_json(F.lit("2.0")))) == "float"


def expected(op, x, y):
    a, b = kind_of(x), kind_of(y)
    scalars, numbers = {"null", "boolean", "string", "int", "float"}, {"int", "float"}
    if op in ("equal", "differ"):
        if a not in scalars or b not in scalars:
            return "RefShapeMismatch"
        if "null" in (a, b):
            same = a == b
        elif a == b:
            same = x == y
        elif {a, b} == numbers:
            same = float(x) == float(y)
        else:
            return "RefShapeMismatch"
        return same == (op == "equal")
    if a not in numbers or b not in numbers:
        return "RefShapeMismatch"
    if a != b:
        x, y = float(x), float(y)
    if op in ("less", "at_most", "greater", "at_least"):
        return {"less": x < y, "at_most": x <= y, "greater": x > y, "at_least": x >= y}[op]
    if op in ("divide", "remainder") and y == 0:
        return "DivisionByZero"
    if a == b == "int":
        if op in ("divide", "remainder"):
            if x == -(1 << 63) and y == -1:
                return "NonFiniteResult"
            q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
            return q if op == "divide" else x - q * y
        z = {"add": x + y, "subtract": x - y, "multiply": x * y}[op]
        return z if -(1 << 63) <= z < 1 << 63 else "NonFiniteResult"
    return {"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y, "divide": lambda: x / y, "remainder": lambda: math.fmod(x, y)}[op]()


@pytest.mark.parametrize("op", ["equal", "differ", "less", "at_most", "greater", "at_least", "add", "subtract", "multiply", "divide", "remainder"])
def test_operators_equal_python_over_all_kinds(spark, op):
    pairs = [(x, y) for x in SOME for y in [*SOME, -1] if not isinstance(expected(op, x, y), str)]
    real = lambda x: x if isinstance(x, float) else None
    rows = spark.createDataFrame([(i, json.dumps(x), real(x), json.dumps(y), real(y)) for i, (x, y) in enumerate(pairs)], "i int, a string, fa double, b string, fb double")
    a, b = (F.when(F.col(f"f{c}").isNotNull(), F.col(f"f{c}").cast("variant")).otherwise(F.parse_json(c)) for c in "ab")
    got = rows.select("i", a.alias("a"), b.alias("b")).select("i", values.as_variant(getattr(values, op)(F.col("a"), F.col("b"))).alias("x"))
    for i, kind, written in got.select("i", values.kind(F.col("x")), F.to_json("x")).collect():
        want = expected(op, *pairs[i])
        assert (kind, json.loads(written)) == (kind_of(want), want), (op, pairs[i])


@pytest.mark.parametrize("op, x, y", [
    ("equal", "1", 1), ("equal", True, 1), ("equal", [], None), ("differ", {}, {}), ("less", "a", "b"), ("at_most", None, 1), ("add", "a", "b"), ("multiply", True, 2), ("subtract", [1], 1),
    ("divide", 1, 0), ("divide", 1.5, 0), ("remainder", 1, 0.0), ("add", (1 << 63) - 1, 1), ("multiply", 1 << 62, 2), ("divide", -(1 << 63), -1), ("remainder", -(1 << 63), -1), ("multiply", 1e200, 1e200),
])
def test_operators_fail_by_kind(spark, op, x, y):
    want = expected(op, x, y) if not (x == y == 1e200) else "NonFiniteResult"
    assert failing(spark, F.to_json(values.as_variant(getattr(values, op)(made_value(x), made_value(y))))) == want


def test_casts_logic_text_and_length(spark):
    v = made_value
    assert one(spark, values.as_int(v(5))) == 5 and one(spark, values.as_float(v(5))) == 5.0 and one(spark, values.as_text(v("5"))) == "5"
    assert [failing(spark, f(v(x))) for f, x in ((values.as_int, 5.0), (values.as_text, 5), (values.as_boolean, None), (values.as_float, "5"), (values.as_array, {}))] == ["RefShapeMismatch"] * 5
    assert one(spark, values.both(v(False), v(7))) is False and one(spark, values.either(v(True), v(7))) is True and failing(spark, values.both(v(True), v(7))) == "RefShapeMismatch"
    assert one(spark, values.opposite(v(False))) is True and one(spark, F.to_json(values.pick(v(True), 1, values.divide(1, 0)))) == "1"
    assert [one(spark, values.text(v(x))) for x in ("a", True, 3, 2.0, 123456789.0, 0.5)] == ["a", "true", "3", "2.0", "123456789.0", "0.5"]
    assert failing(spark, values.text(v(None))) == failing(spark, values.text(v([1]))) == "RefShapeMismatch"
    assert one(spark, values.length(v("é𝄞"))) == 2 and one(spark, values.length(v([1, [2]]))) == 2 and failing(spark, values.length(v({}))) == "RefShapeMismatch"
    assert one(spark, values.holds(v(["a", 1, None]), 1.0)) is True and one(spark, values.holds(v(["1"]), 1)) is False and failing(spark, values.holds(v("ab"), "a")) == "RefShapeMismatch"
    assert one(spark, F.to_json(values.negate(v(3)))) == "-3" and failing(spark, F.to_json(values.negate(v(-(1 << 63))))) == "NonFiniteResult" and failing(spark, F.to_json(values.negate(v("3")))) == "RefShapeMismatch"


DEEP = {"a": [{"b'c]": 1}, [10, 20, 30], "x", None], "n": None, "": 5}


def test_paths(spark):
    v = made_value(DEEP)
    read = lambda *steps: json.loads(one(spark, F.to_json(objects.drill(v, *steps))))
    assert read() == DEEP and read("a", 0, "b'c]") == 1 and read("a", 3) is None and read("n") is None and read("") == 5
    assert read("a", 1, slice(1, None)) == [20, 30] and read("a", 1, slice(0, 99)) == [10, 20, 30] and read("a", slice(2, 1)) == [] and read("a", slice(1, 3), 0, 2) == 30
    assert read("a", F.lit(1), F.lit(2).cast("bigint")) == 30 and read(F.lit("a"), 0, F.concat(F.lit("b'"), F.lit("c]"))) == 1 and read("a", 1, slice(F.lit(1), F.lit(2))) == [20]
    assert one(spark, objects.drill(v, "a", 1, 0, kind="bigint")) == 10
    assert json.loads(one(spark, F.to_json(objects.drill(F.struct(F.array(F.lit(4), F.lit(5)).alias("k")), "k", 1)))) == 5


@pytest.mark.parametrize("steps, kind", [
    (("z",), "MissingObjectKey"), (("a", 9, "b"), "IndexOutOfBounds"), (("a", -1), "IndexOutOfBounds"), (("a", "b"), "RefShapeMismatch"), ((0,), "RefShapeMismatch"), (("n", "k"), "RefShapeMismatch"), (("a", 2, 0), "RefShapeMismatch"),
    (("a", slice(-1, None)), "NegativeSliceBound"), (("a", slice(None, 1.5)), "NonIntegerSliceBound"), ((slice(0, 1),), "RefShapeMismatch"), (("a", slice("x", None)), "RefShapeMismatch"),
    (("a", F.lit, 1.5), "NonIntegerIndex"), ((F.lit, 1.5), "RefShapeMismatch"), (("a", F.lit, "k"), "RefShapeMismatch"), (("a", F.lit, True), "RefShapeMismatch"), ((F.lit, "q"), "MissingObjectKey"), (("a", F.lit, 4), "IndexOutOfBounds"),
])
def test_paths_fail_by_kind(spark, steps, kind):
    if F.lit in steps:
        at = steps.index(F.lit)
        steps = (*steps[:at], F.lit(steps[at + 1]))
    assert failing(spark, F.to_json(objects.drill(made_value(DEEP), *steps))) == kind


def test_wide_ranges(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    u, v = (draws.draw("wide", F.col("id"), i) for i in range(2))
    rows = spark.range(4000).select(
        (u * float(1 << 52)).cast("bigint").alias("u"), (v * float(1 << 52)).cast("bigint").alias("v"), samplers.range_int(low, high, u, v).alias("all"),
        samplers.range_int(-5, (1 << 60) + 3, u, v).alias("part"), samplers.range_int(0, 9, u, v).alias("few"), samplers.range_int(0, 9, u).alias("same"),
    ).collect()
    for r in rows:
        draw = (r.u << 52) + r.v
        assert r["all"] == low + (draw * (1 << 64) >> 104) and r.part == -5 + (draw * ((1 << 60) + 9) >> 104) and r.few == r.same
    assert abs(sum(r["all"] > 0 for r in rows) / 4000 - 0.5) < 0.03 and {k for k, n in Counter(r["all"] % 2 for r in rows).items() if n > 1800} == {0, 1}
    edges = lambda x, y: one(spark, samplers.range_int(low, high, F.lit(x), F.lit(y)))
    top = 1 - 2.0**-52
    assert edges(0.0, 0.0) == low and edges(top, top) == high
    for wrong in (lambda: samplers.range_int(low, high, u), lambda: samplers.range_int(0, 1 << 63, u, v), lambda: samplers.range_int(2, 1, u, v)):
        with pytest.raises(ValueError):
            wrong()
