"""Errors of generation: the same kind and place however the traces are partitioned."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import numbers, objects, strings, values
from loomspan.plans.failures import GenerationError, first_failure, located
from loomspan.plans.shape import Choice, Maybe, Repeat, Span, shape_events
from loomspan.sources import inputs

T = lambda x: F.col("trace_index")


def root(*children, **fields):
    return Span("task", "root", fields, children=list(children))


def turn(*children, count=lambda x: F.lit(3), **more):
    return Repeat("turn", count, list(children), **more)


def output(build, **more):
    return Span("llm", "reply", {"output": build}, **more)


def when(bad, make=lambda: F.lit(1).cast("bigint")):
    """A value that fails in traces from 37 on."""
    return lambda x: F.when(F.col("trace_index") >= 37, bad(x)).otherwise(make())


DEEP = Span("tool", "facts", {"output": lambda x: F.struct(F.array(F.lit(1), F.lit(2)).alias("k"))})
CASES = {
    "DivisionByZero": root(output(when(lambda x: numbers.divide(F.lit(1).cast("bigint"), F.col("trace_index") - F.col("trace_index"))))),
    "NonFiniteResult": root(output(when(lambda x: F.lit((1 << 63) - 1) + F.col("trace_index")))),
    "IndexOutOfBounds": root(output(when(lambda x: objects.index(F.array(F.lit(1), F.lit(2)), F.col("trace_index"))))),
    "NonIntegerIndex": root(DEEP, output(when(lambda x: x.child("facts").field("output", "k", F.lit(0.5)), lambda: values.as_variant(1)))),
    "MissingObjectKey": root(DEEP, output(when(lambda x: x.child("facts").field("output", "q"), lambda: values.as_variant(1)))),
    "NonIntegerSliceBound": root(DEEP, output(when(lambda x: x.child("facts").field("output", "k", slice(0.5, None)), lambda: values.as_variant(1)))),
    "NegativeSliceBound": root(output(when(lambda x: F.size(objects.part(F.array(F.lit(1)), -F.col("trace_index"))).cast("bigint")))),
    "NegativeRepeatCount": root(turn(output(T), count=when(lambda x: -F.col("trace_index")))),
    "NonIntegerRepeatCount": root(turn(output(T), count=when(lambda x: values.as_variant(0.5), lambda: values.as_variant(1)))),
    "ChanceOutOfRange": root(Maybe("aside", [output(T)], when(lambda x: F.lit(1.5), lambda: F.lit(0.5)))),
    "ClampBoundsOutOfOrder": root(output(when(lambda x: numbers.clamp(F.lit(1.0), F.col("trace_index").cast("double"), F.lit(2.0)), lambda: F.lit(1.0)))),
    "JoinElementNotScalar": root(output(when(lambda x: strings.join(F.array(F.lit("a"), F.lit(None).cast("string")), ","), lambda: F.lit("a")))),
    "CircularReference": root(turn(output(lambda x: F.when(F.col("trace_index") >= 37, x.child("turn").iteration(F.lit(2)).child("reply").field("output")).otherwise(1), types={"output": "bigint"}))),
    "AbsentRefField": root(Span("tool", "a", {"output": T}), Span("tool", "a"), output(when(lambda x: x.child("a", position=F.lit(1)).field("output")))),
    "RefShapeMismatch": root(DEEP, output(when(lambda x: values.add(x.child("facts").field("output"), 1), lambda: values.as_variant(1)))),
    "EmptySplitSeparator": root(output(when(lambda x: F.size(strings.split(F.lit("a b"), F.substring(F.lit(" "), 1, (37 - F.col("trace_index")).cast("int")))).cast("bigint")))),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_kinds_and_places(spark, kind):
    roots, field = inputs.trace_range(spark, 60), {"NegativeRepeatCount": "count", "NonIntegerRepeatCount": "count", "ChanceOutOfRange": "chance"}.get(kind, "output")
    block = {"count": "/turn", "chance": "/aside", "output": "/turn#0/reply" if kind == "CircularReference" else "/reply"}[field]
    found = first_failure(roots, CASES[kind], 5)
    assert (found.kind, found.trace_index, found.block, found.field) == (kind, 37, block, field), found
    assert first_failure(roots.where("trace_index < 37"), CASES[kind], 5) is None


def two_errors():
    """Trace 20 fails in the third turn, in a value that two others read; later traces fail at once."""
    bad = lambda x: numbers.divide(F.lit(6).cast("bigint"), F.when((F.col("trace_index") == 20) & (x.index() == 2), 0).otherwise(1).cast("bigint"))
    cost = Span("tool", "cost", {"input": lambda x: x.child("base").field("output") + 1}, {"n": lambda x: x.child("base").field("output")})
    late = Span("llm", "late", {"input": lambda x: objects.index(F.array(F.lit(1)), F.greatest(F.lit(0), F.col("trace_index") - 20)), "output": lambda x: x.child("turn").iterations().child("cost").field("input")})
    return root(turn(cost, Span("tool", "base", {"output": bad})), Choice("way", [late]))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_the_first_error_whatever_the_partitions(spark, parts):
    roots = inputs.trace_range(spark, 40).repartition(parts)
    with pytest.raises(GenerationError) as e, located(roots, two_errors(), 3):
        shape_events(roots, two_errors(), 3).write.format("noop").mode("overwrite").save()
    found = e.value
    assert (found.kind, found.trace_index, found.block, found.field) == ("DivisionByZero", 20, "/turn#2/base", "output")
    assert "trace 20" in str(found) and "/turn#2/base" in str(found)


def test_shapes_in_turn_and_other_errors(spark):
    fine, bad = root(output(T)), root(Span("llm", "bad", metadata={"k": lambda x: objects.index(F.array(F.lit(1)), 1)}))
    found = first_failure(inputs.trace_range(spark, 9), [fine, fine, bad], 1)
    assert (found.kind, found.trace_index, found.block, found.field) == ("IndexOutOfBounds", 2, "/bad", "metadata.k")
    assert first_failure(inputs.trace_range(spark, 9), [fine, fine], 1) is None
    assert first_failure(inputs.trace_range(spark, 9).limit(0), bad, 1) is None
    with pytest.raises(ZeroDivisionError), located(inputs.trace_range(spark, 3), bad, 1):
        1 / 0
    with pytest.raises(Exception, match="NOT_FOUND|cannot be resolved"), located(inputs.trace_range(spark, 3), fine, 1):
        spark.table("nowhere").collect()


def test_a_failing_variable_is_named(spark):
    shape = root(turn(output(lambda x: x.var("v")), vars={"v": lambda x: F.when(x.index() == 1, objects.index(F.array(F.lit(1)), 4)).otherwise(1)}))
    found = first_failure(inputs.trace_range(spark, 3), shape, 1)
    assert (found.kind, found.trace_index, found.block, found.field) == ("IndexOutOfBounds", 0, "/turn#1", "var:v")
